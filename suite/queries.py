"""The registered queries: each takes a session and a table directory."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpustag import lexicon
from corpustag.functions import language as lang
from corpustag.functions import markdown as md
from corpustag.functions import text as tx
from corpustag.operators import annotate, discover, filters, match, migrate, reconcile, rules
from corpustag.plans import incremental, sync
from corpustag.sources import folders, sinks, watch
from corpustag.streaming import changes

from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


def _words(values: Column) -> Column:
    return F.array_join(values, " ")


def _strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _pick(spark: SparkSession, *ids: str, from_rules: list[dict] = fx.RULES) -> DataFrame:
    chosen = fx.rules_frame(spark, from_rules)
    return chosen.where(F.col("id").isin(list(ids))) if ids else chosen


def _match_rows(matches: DataFrame) -> DataFrame:
    return matches.select(
        "doc_id", "rule_id", F.col("text").alias("match_text"), F.col("begin").cast("long").alias("m_begin"),
        F.col("end").cast("long").alias("m_end"))


def _per_document(matches: DataFrame) -> DataFrame:
    return matches.groupBy("doc_id", "rule_id").agg(F.count("*").alias("n"))


# --- Markdown functions -----------------------------------------------------------

@query
def q01_slug_title(spark, sf_dir):
    text = F.col("text")
    return fx.documents(spark, sf_dir).select("doc_id", tx.slug(text).alias("slug"), tx.title(text).alias("title"))


@query
def q02_frontmatter_lines(spark, sf_dir):
    text = F.col("text")
    return fx.notes(spark, sf_dir).select(
        "doc_id", md.front_matter_lines(text).cast("long").alias("fm_lines"),
        tx.content_hash(md.strip_front_matter(text)).alias("body_hash"))


@query
def q03_strip_fences(spark, sf_dir):
    return fx.notes(spark, sf_dir).select(
        "doc_id", tx.content_hash(md.strip_fences(F.col("text"))).alias("text_hash"))


@query
def q04_existing_tags(spark, sf_dir):
    return fx.notes(spark, sf_dir).select("doc_id", _words(md.existing_tags(F.col("text"))).alias("tags"))


@query
def q05_insert_tags(spark, sf_dir):
    return fx.notes(spark, sf_dir).select(
        "doc_id", tx.content_hash(md.insert_tags(F.col("text"), _strings("alpha", "beta/x"))).alias("text_hash"))


_REMOVED = ("stale", "quality/0", "lang/de", "lang")


@query
def q06_remove_tags(spark, sf_dir):
    return fx.notes(spark, sf_dir).select(
        "doc_id", tx.content_hash(md.remove_tags(F.col("text"), _strings(*_REMOVED))).alias("text_hash"))


@query
def q06b_remove_tags_compat(spark, sf_dir):
    return fx.notes(spark, sf_dir).select("doc_id", tx.content_hash(
        md.remove_tags(F.col("text"), _strings(*_REMOVED), compat=True)).alias("text_hash"))


@query
def q37_content_hash(spark, sf_dir):
    return fx.documents(spark, sf_dir).select("doc_id", tx.content_hash(F.col("text")).alias("text_hash"))


# --- Annotation -------------------------------------------------------------------

@query
def q07_token_counts(spark, sf_dir):
    tokens = lang.token_surfaces(F.col("text"))
    return fx.documents(spark, sf_dir).select(
        "doc_id", F.size(tokens).cast("long").alias("n_tokens"),
        F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct"))


@query
def q07b_token_offsets(spark, sf_dir):
    return annotate.tokens(fx.documents(spark, sf_dir)).groupBy("doc_id").agg(
        F.sum("begin").alias("sum_begin"), F.sum("end").alias("sum_end"),
        F.max("tok_no").cast("long").alias("last_token"),
        F.sum(F.when(F.col("surface").rlike("^[A-Z]"), F.col("begin")).otherwise(0)).alias("sum_capital_begin"))


@query
def q08_sentence_counts(spark, sf_dir):
    sents = annotate.sentences(annotate.tokens(fx.documents(spark, sf_dir)))
    return sents.groupBy("doc_id").agg(
        F.count("*").alias("n_sentences"), F.sum("begin").alias("sum_begin"), F.sum("end").alias("sum_end"),
        F.max(F.length("text")).cast("long").alias("longest"))


@query
def q09_paragraphs(spark, sf_dir):
    return annotate.paragraphs(fx.notes(spark, sf_dir)).select(
        "doc_id", F.col("para_no").cast("long").alias("para_no"), F.col("begin").cast("long").alias("p_begin"),
        F.col("end").cast("long").alias("p_end"), tx.content_hash(F.col("text")).alias("text_hash"))


@query
def q10_pos_histogram(spark, sf_dir):
    surfaces = fx.documents(spark, sf_dir).select(
        F.explode(lang.token_surfaces(F.col("text"))).alias("surface"))
    # Label each distinct form once, weighted by its count.
    forms = surfaces.groupBy("surface").agg(F.count("*").alias("n"))
    return forms.groupBy(lang.pos_of(F.col("surface")).alias("pos")).agg(F.sum("n").alias("n"))


@query
def q11_lemma_counts(spark, sf_dir):
    surfaces = fx.documents(spark, sf_dir).select(
        F.explode(lang.token_surfaces(F.col("text"))).alias("surface"))
    forms = surfaces.groupBy("surface").agg(F.count("*").alias("n"))
    return forms.groupBy(lang.lemma_of(F.col("surface")).alias("lemma")).agg(F.sum("n").alias("n"))


@query
def q12_stem_vocab(spark, sf_dir):
    return annotate.stems(annotate.vocabulary(fx.documents(spark, sf_dir)))


@query
def q13_entities_by_type(spark, sf_dir):
    ents = annotate.entities(fx.documents(spark, sf_dir))
    return ents.groupBy("type").agg(
        F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.sum("begin").alias("sum_begin"))


@query
def q13b_page_entities(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    ents = annotate.entities(pages)
    return ents.groupBy("type").agg(
        F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.sum("begin").alias("sum_begin"))


def _sentiment(spark):
    return lexicon.sentiment_lexicon(spark)


@query
def q14_sentence_sentiment(spark, sf_dir):
    toks = annotate.tokens(fx.documents(spark, sf_dir))
    scores = annotate.sentence_sentiment(toks, _sentiment(spark))
    return annotate.sentence_bounds(toks).join(scores, ["doc_id", "sent_no"], "left").select(
        "doc_id", F.col("sent_no").cast("long").alias("sent_no"), F.coalesce("score", F.lit(0.0)).alias("score"))


@query
def q14b_document_sentiment(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    toks = annotate.tokens(docs)
    by_sentence = annotate.document_sentiment(toks, _sentiment(spark)).withColumnRenamed("score", "mean_score")
    whole = annotate.document_sentiment(toks, _sentiment(spark), "document").withColumnRenamed("score", "whole_score")
    return docs.select("doc_id").join(by_sentence, "doc_id", "left").join(whole, "doc_id", "left").select(
        "doc_id", F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"),
        F.coalesce("whole_score", F.lit(0.0)).alias("whole_score"))


# --- Matchers ---------------------------------------------------------------------

@query
def q15_pattern_matches(spark, sf_dir):
    toks = annotate.tokens(fx.documents(spark, sf_dir))
    return match.match_patterns(toks, _pick(spark)).select(
        "doc_id", "rule_id", F.col("text").alias("match_text"), F.col("begin").cast("long").alias("m_begin"),
        F.col("end").cast("long").alias("m_end"), _words(F.col("pos_tags")).alias("pos_tags"))


@query
def q16_keyword_matches(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    active = rules.active_rules(_pick(spark))
    return _match_rows(match.match_keywords(
        annotate.tokens(docs), active, annotate.vocabulary(docs)))


@query
def q17_literal_matches(spark, sf_dir):
    return _match_rows(match.match_literals(fx.documents(spark, sf_dir), _pick(spark)))


@query
def q17b_literal_counts(spark, sf_dir):
    return match.count_phrases(fx.documents(spark, sf_dir), _pick(spark)).select("doc_id", "rule_id", "n")


@query
def q17c_many_phrases(spark, sf_dir):
    """Every whole benchmark item as a phrase, by way of trigrams."""
    phrases = fx.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("rule_no"), F.col("item_id").cast("string").alias("rule_id"),
        F.lower("text").alias("phrase"))
    return match.phrase_pairs(fx.documents(spark, sf_dir), phrases, inline_limit=0).select(
        "doc_id", "rule_no", "phrase")


@query
def q18_entity_matches(spark, sf_dir):
    return _match_rows(match.match_entities(annotate.entities(fx.documents(spark, sf_dir)), _pick(spark)))


@query
def q19_legacy_keywords(spark, sf_dir):
    return match.match_legacy_keywords(fx.notes(spark, sf_dir), fx.legacy_keywords(spark)).select(
        "doc_id", "keyword")


@query
def q19b_legacy_reconcile(spark, sf_dir):
    out = reconcile.legacy_reconcile(fx.notes(spark, sf_dir), fx.legacy_keywords(spark))
    return out.select("doc_id", "modified", _words(F.col("added")).alias("added"),
                      _words(F.col("matched_keywords")).alias("matched_keywords"))


# --- Filters ----------------------------------------------------------------------

@query
def q20_pos_filter(spark, sf_dir):
    chosen = _pick(spark, "r02", "r09", "r12")
    return _per_document(filters.filter_pos(match.match_rules(fx.documents(spark, sf_dir), chosen), chosen))


@query
def q21_entity_filter(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    chosen = _pick(spark, "r03", "r10")
    return _per_document(filters.filter_entities(match.match_rules(docs, chosen), chosen, docs))


@query
def q22_entity_filter_scoped(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    chosen = _pick(spark, from_rules=fx.ENTITY_SCOPE_RULES)
    kept = filters.apply_filters(match.match_rules(docs, chosen), chosen, docs, entity_scope="honor")
    return _per_document(kept)


@query
def q23_sentiment_filter(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    chosen = _pick(spark, "r11")
    return _per_document(filters.apply_filters(match.match_rules(docs, chosen), chosen, docs))


@query
def q23b_sentiment_scopes(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    chosen = _pick(spark, from_rules=fx.SCOPED_RULES)
    return _per_document(filters.apply_filters(match.match_rules(docs, chosen), chosen, docs))


# --- Tagging ----------------------------------------------------------------------

@query
def q24_expected_tags(spark, sf_dir):
    return sync.document_tags(fx.documents(spark, sf_dir), _pick(spark)).select(
        "doc_id", _words(F.col("matched_rules")).alias("matched_rules"), _words(F.col("expected")).alias("expected"))


@query
def q24b_expected_tags_by_matches(spark, sf_dir):
    """The same answer from the match tables, as with annotations of one's own."""
    active = rules.active_rules(_pick(spark))
    hits = sync.rule_hits(fx.documents(spark, sf_dir), active)
    return reconcile.expected_tags(hits, active).select(
        "doc_id", _words(F.col("matched_rules")).alias("matched_rules"), _words(F.col("expected")).alias("expected"))


def _diff_rows(diff: DataFrame) -> DataFrame:
    return diff.select("doc_id", "modified", *[_words(F.col(c)).alias(c) for c in ("added", "removed", "matched_rules")])


@query
def q25_tag_diff(spark, sf_dir):
    return _diff_rows(sync.tag_diff(fx.notes(spark, sf_dir), _pick(spark)))


@query
def q25b_tag_diff_map_only(spark, sf_dir):
    """Rules without position-bound filters: one pass over the notes, no shuffle of its own."""
    plain = _pick(spark).where("id <> 'r11'")
    return _diff_rows(sync.tag_diff(fx.notes(spark, sf_dir), plain))


@query
def q25c_tag_diff_by_joins(spark, sf_dir):
    """The plan for rule sets too large to fold in, forced on the fixture rules."""
    return _diff_rows(sync.tag_diff(fx.notes(spark, sf_dir), _pick(spark), inline_limit=0))


@query
def q26_reconciled_text(spark, sf_dir):
    done = sync.reconcile(fx.notes(spark, sf_dir), _pick(spark))
    return sinks.modified_only(done).select("doc_id", tx.content_hash(F.col("text")).alias("text_hash"))


@query
def q27_sync_summary(spark, sf_dir):
    return reconcile.sync_summary(sync.tag_diff(fx.notes(spark, sf_dir), _pick(spark)))


@query
def q27b_sync_summary_by_alias(spark, sf_dir):
    diff = sync.tag_diff(fx.notes(spark, sf_dir, F.col("source").alias("alias")), _pick(spark))
    return reconcile.sync_summary(diff, "alias")


@query
def q28_migrate_tags(spark, sf_dir):
    out = migrate.migrate_tags(fx.notes(spark, sf_dir), ["stale", "lang/fr"], ["archived", "quality/1"])
    return out.select("doc_id", tx.content_hash(F.col("text")).alias("text_hash"))


@query
def q29_bulk_remove(spark, sf_dir):
    out = migrate.bulk_remove(fx.notes(spark, sf_dir), ["stale", "quality/1"])
    return out.select("doc_id", tx.content_hash(F.col("text")).alias("text_hash"))


@query
def q30_rule_coverage(spark, sf_dir):
    return sync.rule_coverage(fx.documents(spark, sf_dir), _pick(spark)).select("rule_id", "match_count")


# --- Discovery --------------------------------------------------------------------

@query
def q31_top_keywords(spark, sf_dir):
    return discover.top_keywords(fx.documents(spark, sf_dir))


@query
def q31b_keyword_samples(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    top = discover.top_keywords(docs, 20)
    return discover.keyword_samples(docs, top).select(
        "keyword", _words(F.transform("sample_files", lambda d: d.cast("string"))).alias("sample_files"))


@query
def q32_top_phrases(spark, sf_dir):
    return discover.top_phrases(fx.documents(spark, sf_dir), "DET NOUN")


@query
def q33_concordance(spark, sf_dir):
    return discover.concordance(fx.documents(spark, sf_dir), "clown", "lemma").select(
        "doc_id", F.col("tok_no").cast("long").alias("tok_no"), "surface")


@query
def q33b_concordance_total(spark, sf_dir):
    return discover.concordance_total(fx.documents(spark, sf_dir), "the")


@query
def q33c_concordance_per_document(spark, sf_dir):
    return discover.concordance_per_document(fx.documents(spark, sf_dir), "the", first=3).select(
        "doc_id", F.col("tok_no").cast("long").alias("tok_no"), "surface", F.col("rank").cast("long").alias("rank"))


@query
def q34_rule_preview(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    chosen = _pick(spark, "r01", "r03", "r05", "r08")
    preview = discover.rule_preview(match.match_rules(docs, chosen), docs)
    return preview.select(
        "rule_id", F.col("sample_no").cast("long").alias("sample_no"), "path", "match_text",
        F.col("line").cast("long").alias("line"), "context", "match_count")


# --- Rule sets --------------------------------------------------------------------

@query
def q35_rule_import(spark, sf_dir):
    good, _, _ = rules.import_rules(fx.derived_rule_json(spark, sf_dir))
    return good.select("rule_no", "id", "type", "match", _words(F.col("tags")).alias("tags"),
                       F.col("filters.sentiment.min").alias("sentiment_min"),
                       F.col("modified").isNull().alias("is_fresh"))


@query
def q35b_rule_quarantine(spark, sf_dir):
    _, bad, _ = rules.import_rules(fx.derived_rule_json(spark, sf_dir))
    return bad.select("rule_no", F.array_join("errors", "; ").alias("errors"))


def _merged(spark, sf_dir):
    return rules.merge_config(fx.rules_frame(spark), fx.stored_groups(spark, sf_dir), fx.derived_config_json(spark, sf_dir))


@query
def q47_merge_groups(spark, sf_dir):
    """Stored groups and those that the payloads bring, and what became of each."""
    _, groups, report = _merged(spark, sf_dir)
    return groups.select("name", "description").join(report.where("kind = 'group'").select("name", "outcome"), "name", "left")


@query
def q47b_import_counts(spark, sf_dir):
    return rules.import_counts(_merged(spark, sf_dir)[2])


@query
def q36_group_effects(spark, sf_dir):
    applied = rules.apply_groups(fx.derived_rules(spark, sf_dir), fx.rule_groups(spark))
    return applied.select("id", "enabled", _words(F.col("tags")).alias("tags"))


@query
def q36b_select_rules(spark, sf_dir):
    chosen = rules.select_rules(fx.derived_rules(spark, sf_dir), enabled=True, disabled=True, group="third")
    return chosen.select("id")


# --- Change streams ---------------------------------------------------------------

def _hour() -> Column:
    return F.floor(F.unix_seconds(F.col("ts")) / 3600)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")


@query
def q38_changed_only(spark, sf_dir):
    return changes.changed_batch(
        _events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type"), _hour()
    ).select("event_id", "user_id", "event_type")


@query
def q39_debounce(spark, sf_dir):
    return changes.debounced_batch(
        _events(spark, sf_dir), "user_id", "ts", "event_id", 1800, _hour()
    ).select("event_id", "user_id", "event_type")


def _work_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder the session names."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/corpustag-{uuid.uuid4().hex}"


# Events reach the stream in slices of their time; of some slices every 97th event comes two slices late.
SLICES, LATE_BY, LATE_EVERY = 4, 2, 97


def _event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of notes: errors delete, sign-ups create, every tenth user's file is no markdown."""
    events = fx.table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    ends = events.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    n = F.floor((F.col("us") - F.col("lo")) * SLICES / (F.col("hi") - F.col("lo") + 1))
    late = (F.col("event_id") % LATE_EVERY == 0) & (n + LATE_BY < SLICES)
    ending = F.when(F.col("user_id") % 10 == 0, ".txt").otherwise(".md")
    return events.crossJoin(F.broadcast(ends)).select(
        F.concat(F.col("user_id").cast("string"), ending).alias("path"), F.timestamp_micros("us").alias("version_ts"),
        F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "create").otherwise("modify").alias("op"),
        F.col("event_type").alias("text"), F.lit(None).cast("boolean").alias("own"),
        F.when(late, n + LATE_BY).otherwise(n).cast("int").alias("slice"))


def _moved(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder, so that all its files appear at once."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    path(source).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(source), path(target))


def _live(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame], closing: str | None = None) -> DataFrame:
    """What a running stream returns while slices of events arrive, one after the other.

    ``closing`` is how long after the last event a last row without a path tells the time.
    """
    folder = _work_dir(spark)
    versions = _event_versions(spark, sf_dir)
    arrivals = [versions.where(F.col("slice") == k).drop("slice") for k in range(SLICES)]
    if closing:
        arrivals.append(versions.agg((F.max("version_ts") + F.expr(f"INTERVAL {closing}")).alias("version_ts")).select(
            F.lit(None).cast("string").alias("path"), "version_ts", F.lit("tick").alias("op"), F.lit(None).cast("string").alias("text"),
            F.lit(None).cast("boolean").alias("own")))
    spark.createDataFrame([], changes.VERSION_SCHEMA).write.parquet(f"{folder}/in/first")
    stream = build(spark.readStream.schema(changes.VERSION_SCHEMA).parquet(f"{folder}/in/*"))
    running = stream.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", f"{folder}/checkpoint").start(f"{folder}/out")
    try:
        for k, rows in enumerate(arrivals):
            rows.write.parquet(f"{folder}/to_come/{k}")
            _moved(spark, f"{folder}/to_come/{k}", f"{folder}/in/{k}")
            running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query
def q38b_stream_changed_only(spark, sf_dir):
    """T2, T4 and T6 as a running stream with keyed state."""
    out = _live(spark, sf_dir, lambda versions: changes.changed_versions(changes.note_events(versions)))
    return out.select("path", F.unix_micros("version_ts").alias("version_us"), "text")


@query
def q39b_stream_debounce(spark, sf_dir):
    """T3, T4 and T6 as a running stream with timers; the time goes on after the last event, so all bursts come out."""
    out = _live(spark, sf_dir, lambda versions: changes.debounced(
        changes.note_events(versions, ticks=True), "30 minutes", "1 minute"), "32 MINUTES")
    return out.select("path", F.unix_micros("version_ts").alias("version_us"), "text")


@query
def q42_folder_changes(spark, sf_dir):
    """Every document as a file; French ones are edited in place once, German ones twice, while the folder is watched."""
    folder = _work_dir(spark)
    docs = fx.table(spark, sf_dir, "documents").select(
        F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    edits = [docs] + [docs.where(F.col("lang").isin(chosen)).withColumn("text", F.concat("text", F.lit(f"\nedit {n}")))
                      for n, chosen in ((1, ["fr", "de"]), (2, ["de"]))]
    for rows in edits:
        sinks.write_files(rows, f"{folder}/notes")
        stream = changes.note_events(watch.read_folder(spark, f"{folder}/notes", settle=0)).select("path", "version_ts", "op", "text")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(
            availableNow=True).start(f"{folder}/seen").awaitTermination()
    seen = spark.read.schema(stream.schema).parquet(f"{folder}/seen")
    return seen.groupBy(F.regexp_extract("path", r"([^/]+)\.md\z", 1).cast("long").alias("doc_id")).agg(
        F.count("*").alias("n_versions"), F.count_if(F.col("op") == "create").alias("n_created"),
        tx.content_hash(F.max_by("text", "version_ts")).alias("text_hash"))


@query
def q43_echo_loop(spark, sf_dir):
    """All notes are tagged as they appear, the rewrites come back as changes, and none of those is acted on."""
    folder = _work_dir(spark)
    notes = fx.notes(spark, sf_dir).select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit("2024-01-01").cast("timestamp").alias("version_ts"),
        F.lit("create").alias("op"), "text", F.lit(None).cast("boolean").alias("own"))
    notes.write.parquet(f"{folder}/versions/0")
    ledger = changes.Ledger(spark, f"{folder}/ledger")
    rules_without_positions = _pick(spark).where("id <> 'r11'")

    def write_back(modified: DataFrame, batch: int) -> None:
        modified.select("path", (F.col("version_ts") + F.expr("INTERVAL 1 MINUTE")).alias("version_ts"), F.lit("modify").alias("op"),
                        "text", F.lit(None).cast("boolean").alias("own")).write.mode("overwrite").parquet(f"{folder}/versions/{batch + 1}")

    for _ in range(3):
        versions = spark.readStream.schema(changes.VERSION_SCHEMA).parquet(f"{folder}/versions/*")
        changes.start_tagging(changes.changed_versions(changes.note_events(versions)), rules_without_positions, write_back,
                              f"{folder}/checkpoint", once=True, ledger=ledger).awaitTermination()
    came = spark.read.schema(changes.VERSION_SCHEMA).parquet(f"{folder}/versions/*").groupBy("path").agg(
        F.count("*").alias("n_versions"), tx.content_hash(F.max_by("text", "version_ts")).alias("text_hash"))
    acted = ledger.rows().groupBy("path").agg(F.count("*").alias("n_acted"))
    return came.join(acted, "path", "left").select(
        F.regexp_extract("path", "^[0-9]+", 0).cast("long").alias("doc_id"), "n_versions", "n_acted", "text_hash")


@query
def q44_scan_notes(spark, sf_dir):
    """Every document as a file some folders deep, beside files and folders that a scan leaves out."""
    folder = _work_dir(spark)
    place = F.concat(F.col("lang"), F.lit("/_"), F.col("source"), F.lit("/"))
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(place, F.lit("")).alias("place"))
    name = F.concat(F.lit("."), F.col("doc_id").cast("string"))
    kinds = F.array(F.concat("place", name, F.lit(".md")), F.concat("place", name, F.lit(".MD")), F.concat("place", F.lit(".git/"), name, F.lit(".md")))
    sinks.write_files(docs.select(F.explode(kinds).alias("path"), "text"), f"{folder}/tree")
    found = folders.notes(spark, f"{folder}/tree")
    return found.select(F.regexp_extract("path", r"([0-9]+)\.md\z", 1).cast("long").alias("doc_id"), tx.content_hash(F.col("text")).alias("text_hash"))


@query
def q45_incremental_sync(spark, sf_dir):
    """T2 as a batch: all notes; then the edited ones; nothing; all again once a rule is gone. The runs that touched a note."""
    folder = _work_dir(spark)
    state = incremental.SyncState(spark, f"{folder}/state")
    plain = _pick(spark).where("id <> 'r11'")
    docs = fx.notes(spark, sf_dir, "lang")

    def keep(done: DataFrame, run: int) -> None:
        done.write.mode("overwrite").parquet(f"{folder}/done/run={run}")

    for number, active in ((1, plain), (2, plain), (3, plain), (4, plain.where("id <> 'r01'"))):
        incremental.sync_changed(docs, active, state, keep, run=number)
        docs = sinks.refreshed(docs, spark.read.parquet(f"{folder}/done/run={number}"))
        if number == 1:
            docs = docs.withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit("\nedited"))).otherwise(F.col("text")))
        docs.write.parquet(f"{folder}/corpus/{number}")
        docs = spark.read.parquet(f"{folder}/corpus/{number}")
    done = spark.read.parquet(f"{folder}/done")
    return done.groupBy("doc_id").agg(
        F.min_by("modified", "run").alias("modified"), F.array_join(F.sort_array(F.collect_set(F.col("run").cast("string"))), " ").alias("runs"))


@query
def q46_statistics_over_runs(spark, sf_dir):
    """G11 over two runs, the second of which is repeated."""
    runs = reconcile.statistics_over_runs(spark, f"{_work_dir(spark)}/statistics")
    plain = _pick(spark).where("id <> 'r11'")
    for number in (0, 1, 1):
        runs.record(sync.rule_coverage(fx.documents(spark, sf_dir), plain), number)
    return reconcile.merged_statistics(runs.rows()).select("rule_id", "match_count")


# --- Notes ------------------------------------------------------------------------

@query
def q40_note_collisions(spark, sf_dir):
    saved = sinks.note_frame(fx.documents(spark, sf_dir, F.col("source").alias("alias")))
    return saved.select("alias", "slug", "filename", tx.content_hash(F.col("text")).alias("text_hash"),
                        "collisions", "doc_id")


@query
def q41_full_refresh(spark, sf_dir):
    docs = fx.notes(spark, sf_dir)
    changed = migrate.bulk_remove(docs, ["stale"])
    return sinks.refreshed(docs, changed).select("doc_id", tx.content_hash(F.col("text")).alias("text_hash"))
