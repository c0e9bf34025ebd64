"""Discovery: frequent keywords, phrases of a part-of-speech pattern, concordances, previews.

Corpus counts come from one pass: each document is turned into its tokens inside the
row, exploded and combined map-side, so a shuffle carries the vocabulary and not the
text, and a term found in a third of all documents is one counter per task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import language as lang
from ..functions.text import let
from .scale import BROADCAST_ROWS, INLINE_RULES, bounded_rows, held, lookup_join, one_by_one, settled

# What counts as a content word, and the usual list length.
CONTENT_POS = ["NOUN", "VERB", "ADJ", "PROPN"]
DEFAULT_LIMIT = 50


def _content_lemmas(tokens: Column) -> Column:
    """Lower-cased lemmas (over two characters) of the content words among tokens."""
    content = F.filter(tokens, lambda s: lang.pos_of(s).isin(CONTENT_POS))
    return F.filter(F.transform(content, lambda s: F.lower(lang.lemma_of(s))), lambda l: F.length(l) > 2)


def keyword_counts(docs: DataFrame) -> DataFrame:
    """D1 before the cut: ``(keyword, n)`` for every content lemma.

    Surface forms are counted first, so part of speech and lemma are worked out once per
    form of the vocabulary and not once per token.
    """
    forms = one_by_one(docs, [], lang.token_surfaces(F.col("text")), "form").groupBy("form").agg(F.count("*").alias("n"))
    lemma = F.lower(lang.lemma_of(F.col("form")))
    content = lang.pos_of(F.col("form")).isin(CONTENT_POS) & (F.length(lemma) > 2)
    return forms.where(content).groupBy(lemma.alias("keyword")).agg(F.sum("n").alias("n"))


def _holding(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """Distinct ``(doc_id, keyword)`` for the given keywords, cut down within the row."""
    lemmas = _content_lemmas(F.array_distinct(lang.token_surfaces(F.col("text"))))
    wanted = bounded_rows(keywords.select("keyword"), INLINE_RULES)
    if wanted is not None:
        lemmas = F.array_intersect(lemmas, F.lit(sorted({r["keyword"] for r in wanted}) or [""]))
        return one_by_one(docs, ["doc_id"], lemmas, "keyword")
    held = one_by_one(docs, ["doc_id"], F.array_distinct(lemmas), "keyword")
    return lookup_join(held, keywords.select("keyword"), ["keyword"], "left_semi")


def top_keywords(docs: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The most frequent content lemmas with occurrences and documents, ties by lemma.

    Documents are counted for the winners only, in a second look at the corpus.
    """
    top = settled(keyword_counts(docs).orderBy(F.desc("n"), "keyword").limit(limit), BROADCAST_ROWS)
    files = _holding(docs, top).groupBy("keyword").agg(F.count("*").alias("file_count"))
    return files.join(top, "keyword").select("keyword", "n", "file_count").orderBy(F.desc("n"), "keyword")


def top_keywords_of_tokens(toks: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """D1 over a token table of any annotator."""
    keyed = toks.where(F.col("pos").isin(CONTENT_POS)).select(
        "doc_id", F.lower("lemma").alias("keyword")).where(F.length("keyword") > 2)
    return keyed.groupBy("keyword").agg(
        F.count("*").alias("n"), F.count_distinct("doc_id").alias("file_count")
    ).orderBy(F.desc("n"), "keyword").limit(limit)


def keyword_samples(docs: DataFrame, keywords: DataFrame, samples: int = 5) -> DataFrame:
    """D1's sample files: per keyword the first documents, in id order, that hold it.

    Ranking keeps at most ``samples`` rows per keyword in each task before the shuffle.
    """
    found = _holding(docs, keywords)
    w = Window.partitionBy("keyword").orderBy("doc_id")
    first = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= samples)
    return first.groupBy("keyword").agg(F.sort_array(F.collect_list("doc_id")).alias("sample_files"))


def top_phrases(docs: DataFrame, pattern: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The most frequent phrases of a part-of-speech pattern, ties by phrase.

    The pattern slides over each document's label array inside the row; phrases never
    span documents.
    """
    labels = pattern.split()
    n = len(labels)

    def phrases(tokens: Column) -> Column:
        def matched(pos: Column) -> Column:
            starts = F.when(F.size(pos) >= n, F.sequence(F.lit(0), F.size(pos) - n)).otherwise(
                F.array().cast("array<int>"))

            def fits(i: Column) -> Column:
                test = pos[i] == labels[0]
                for j, label in enumerate(labels[1:], start=1):
                    test = test & (pos[i + j] == label)
                return test

            return F.transform(F.filter(starts, fits), lambda i: F.lower(
                F.array_join(F.slice(tokens, i + 1, F.lit(n)), " ")))
        return let(F.transform(tokens, lang.pos_of), matched)

    def counted(found: Column) -> Column:
        return F.concat(
            F.transform(found, lambda p: F.struct(p.alias("phrase"), F.lit(1).alias("n"), F.lit(0).alias("d"))),
            F.transform(F.array_distinct(found), lambda p: F.struct(
                p.alias("phrase"), F.lit(0).alias("n"), F.lit(1).alias("d"))))

    listed = one_by_one(docs, [], let(let(lang.token_surfaces(F.col("text")), phrases), counted), "p")
    return listed.groupBy(F.col("p.phrase").alias("phrase")).agg(
        F.sum("p.n").alias("n"), F.sum("p.d").alias("file_count")
    ).orderBy(F.desc("n"), "phrase").limit(limit)


def top_phrases_of_tokens(toks: DataFrame, pattern: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """D2 over a token table of any annotator."""
    labels = pattern.split()
    w = Window.partitionBy("doc_id").orderBy("tok_no")
    ahead = toks.select(
        "doc_id", F.array(*[F.lead("pos", i).over(w) if i else F.col("pos") for i in range(len(labels))]).alias("pos"),
        F.array(*[F.lead("surface", i).over(w) if i else F.col("surface") for i in range(len(labels))]).alias("words"))
    found = ahead.where(F.col("pos") == F.array(*[F.lit(label) for label in labels])).select(
        "doc_id", F.lower(F.array_join("words", " ")).alias("phrase"))
    return found.groupBy("phrase").agg(
        F.count("*").alias("n"), F.count_distinct("doc_id").alias("file_count")
    ).orderBy(F.desc("n"), "phrase").limit(limit)


def _key(kind: str) -> Callable[[Column], Column]:
    return {"surface": F.lower, "lemma": lambda s: F.lower(lang.lemma_of(s))}[kind]


def keyword_hits(docs: DataFrame, word: str, kind: str = "surface") -> DataFrame:
    """D3: every ``(doc_id, tok_no, surface)`` whose surface or lemma is the word.

    For stems, pass ``kind='stem'``: the vocabulary's terms with that stem are looked up.
    """
    numbered = F.transform(lang.token_surfaces(F.col("text")), lambda s, i: F.struct(
        i.alias("tok_no"), s.alias("surface")))
    if kind != "stem":
        reduce = _key(kind)
        found = F.filter(numbered, lambda t: reduce(t["surface"]) == word.lower())
        return one_by_one(docs, ["doc_id"], found, "tok_no", "surface")
    from .annotate import stems, vocabulary
    terms = stems(vocabulary(docs)).where(F.col("stem") == word.lower()).select("term")
    listed = one_by_one(docs, ["doc_id"], numbered, "tok_no", "surface").withColumn("term", F.lower("surface"))
    return lookup_join(listed, terms, ["term"], "left_semi").drop("term")


def concordance(docs: DataFrame, word: str, kind: str = "surface", limit: int = DEFAULT_LIMIT) -> DataFrame:
    """D3's sample list: the first hits in document and token order."""
    return keyword_hits(docs, word, kind).orderBy("doc_id", "tok_no").limit(limit)


def concordance_total(docs: DataFrame, word: str, kind: str = "surface") -> DataFrame:
    """D3's head line: how many hits, in how many documents."""
    return keyword_hits(docs, word, kind).agg(
        F.count("*").alias("n"), F.count_distinct("doc_id").alias("file_count"))


def concordance_per_document(docs: DataFrame, word: str, kind: str = "surface", first: int = 5) -> DataFrame:
    """D3 by document: the first hits of each one."""
    w = Window.partitionBy("doc_id").orderBy("tok_no")
    return keyword_hits(docs, word, kind).withColumn("rank", F.row_number().over(w)).where(
        F.col("rank") <= first)


def rule_preview(matches: DataFrame, docs: DataFrame, samples: int = 5) -> DataFrame:
    """Per rule its match count and first matches with line number and line.

    Matches are worked out once, where the session names a checkpoint folder: they are counted and ranked. At most
    ``samples`` matches per rule meet the texts again. ``docs`` may carry a ``path``; the id stands in otherwise.
    """
    matches = held(matches.select("rule_id", "doc_id", "begin", "end", "text"))
    counts = matches.groupBy("rule_id").agg(F.count("*").alias("match_count"))
    w = Window.partitionBy("rule_id").orderBy("doc_id", "begin", "end")
    first = matches.select("rule_id", "doc_id", "begin", "end", F.col("text").alias("match_text")).withColumn(
        "sample_no", F.row_number().over(w)).where(F.col("sample_no") <= samples)
    path = F.col("path") if "path" in docs.columns else F.col("doc_id").cast("string")
    texts = docs.select("doc_id", path.alias("path"), "text")
    # At most rules x samples rows: read once, then looked up from the texts.
    joined = lookup_join(texts, settled(first, BROADCAST_ROWS), ["doc_id"])
    head = F.substring("text", F.lit(1), F.col("begin"))
    newlines = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    shown = joined.withColumn("line", newlines + 1).select(
        "rule_id", "sample_no", "path", "match_text", "line",
        F.element_at(F.split("text", "\n", -1), F.col("line")).alias("context"))
    return lookup_join(shown, settled(counts), ["rule_id"])
