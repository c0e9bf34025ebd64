"""SQL twins of the registered queries, for DuckDB.

Built from named CTE blocks: each query lists the blocks it needs. Patterns are the
library's, with the possessive loops RE2 lacks turned into plain ones.
"""

from __future__ import annotations

from corpustag import lexicon
from corpustag.functions import language as lang
from corpustag.functions.text import WS, WS_CHARS

from . import fixtures as fx


def q(text: str) -> str:
    """A quoted SQL string."""
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    return q(pattern.replace("*+", "*").replace(")++", ")+").replace("]++", "]+"))


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::VARCHAR[]"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


NL = "chr(10)"
BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"


def trim(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^{WS}+', ''), '{WS}+\\z', '')"


# --- Shared pieces ----------------------------------------------------------------

NOTES = f"""
N AS (
  SELECT d.doc_id, d.source,
    '---' || {NL} || 'lang: ' || d.lang || {NL} || '---' || {NL} || d.text || {NL} || {NL}
    || '```sh' || {NL} || 'x #in-code' || {NL} || '```' || {NL}
    || CASE WHEN d.doc_id % 3 = 0 THEN '#lang/' || d.lang || ' #stale' || {NL} ELSE '' END
    || CASE WHEN l.doc_id IS NOT NULL THEN '#quality/' || l.quality || {NL} ELSE '' END
    || CASE WHEN d.doc_id % 7 = 0 THEN '```' || {NL} || '#unclosed' ELSE '' END AS text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def lines_of(name: str, source: str, text: str = "text") -> str:
    """Lines with 1-based numbers, and the front matter's length per document."""
    return f"""
{name} AS (
  SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i
  FROM (SELECT doc_id, string_split({text}, {NL}) AS a FROM {source})),
{name}_fm AS (
  SELECT doc_id, CASE WHEN max(CASE WHEN i = 1 THEN line END) = '---'
      THEN coalesce(min(CASE WHEN i > 1 AND line = '---' THEN i END), 0) ELSE 0 END AS fm
  FROM {name} GROUP BY doc_id)"""


def tokens_of(source: str) -> str:
    surface = f"trim(piece, {BLANKS})"
    tail = f"ltrim(piece, {BLANKS})"
    return f"""
pieces AS (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS tok_no
  FROM (SELECT doc_id, regexp_extract_all(text, {re2(rf'\s*(?:{lang.TOKEN})\s*')}) AS p FROM {source})),
placed AS (
  SELECT doc_id, tok_no, {surface} AS surface, {tail} AS tail, piece,
    CASE WHEN {surface} IN ('.', '!', '?') OR contains({tail}, {NL}) THEN 1 ELSE 0 END AS brk
  FROM pieces),
tok AS (
  SELECT doc_id, tok_no, surface, lower(surface) AS term,
    coalesce(sum(brk) OVER w, 0) AS sent_no,
    coalesce(sum(length(piece)) OVER w, 0) + length(piece) - length(tail) AS b,
    coalesce(sum(length(piece)) OVER w, 0) + length(piece) - length(tail) + length(surface) AS e,
    {pos_case('surface')} AS pos, {lemma_case('surface')} AS lemma
  FROM placed
  WINDOW w AS (PARTITION BY doc_id ORDER BY tok_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def pos_case(s: str) -> str:
    known = " ".join(
        f"WHEN lower({s}) IN {in_list(terms)} THEN {q(pos)}" for pos, terms in lexicon.POS_TERMS.items())
    x = re2(rf"^(?:{lang.URL}|{lang.EMAIL}|[#@][A-Za-z0-9_])")
    return f"""CASE {known}
      WHEN regexp_matches({s}, '^[0-9]') THEN 'NUM'
      WHEN regexp_matches({s}, {x}) THEN 'X'
      WHEN regexp_matches({s}, '^\\p{{P}}') THEN 'PUNCT'
      WHEN NOT regexp_matches({s}, '^\\p{{L}}') THEN 'SYM'
      WHEN regexp_matches({s}, '^\\p{{Lu}}') THEN 'PROPN'
      WHEN regexp_matches(lower({s}), '..(?:ing|ed)$') THEN 'VERB'
      WHEN regexp_matches(lower({s}), '..ly$') THEN 'ADV'
      WHEN regexp_matches(lower({s}), '..(?:ble|ful|ous)$') THEN 'ADJ'
      ELSE 'NOUN' END"""


def lemma_case(s: str) -> str:
    t = f"lower({s})"
    known = " ".join(f"WHEN {t} = {q(w)} THEN {q(l)}" for w, l in lexicon.IRREGULAR_LEMMAS.items())
    return f"""CASE {known}
      WHEN regexp_matches({t}, '...ies$') THEN regexp_replace({t}, 'ies$', 'y')
      WHEN regexp_matches({t}, '..(?:ss|sh|ch|x|z)es$') THEN regexp_replace({t}, 'es$', '')
      WHEN regexp_matches({t}, '(?:ss|us|is)$') THEN {t}
      WHEN regexp_matches({t}, '...s$') THEN regexp_replace({t}, 's$', '')
      WHEN regexp_matches({t}, '....ing$') THEN regexp_replace({t}, 'ing$', '')
      WHEN regexp_matches({t}, '....ed$') THEN regexp_replace({t}, 'ed$', '')
      ELSE {t} END"""


def entities_of(source: str) -> str:
    surface = f"trim(piece, {BLANKS})"
    shapes = " ".join(
        f"WHEN regexp_matches(surface, {re2(rf'^(?:{shape})$')}) THEN {q(name)}"
        for name, shape in lang.ENTITY_SHAPES)
    return f"""
epieces AS (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, {re2(rf'\s*(?:{lang.ENTITY_OR_WORD}|[^\s])\s*')}) AS p
        FROM {source})),
eplaced AS (
  SELECT doc_id, i, {surface} AS surface,
    coalesce(sum(length(piece)) OVER w, 0) + length(piece) - length(ltrim(piece, {BLANKS})) AS b
  FROM epieces
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
typed AS (
  SELECT doc_id, surface, b, b + length(surface) AS e,
    CASE WHEN regexp_matches(surface, {re2(rf'^(?:{lang.WORD})$')}) THEN
           CASE WHEN lower(surface) IN {in_list(lexicon.DATE_WORDS)} THEN 'DATE'
                WHEN lower(surface) IN {in_list(lexicon.ORDINAL_WORDS)} THEN 'ORDINAL' END
         {shapes} END AS type
  FROM eplaced),
ent AS (SELECT * FROM typed WHERE type IS NOT NULL)"""


VALENCE = "val(term, v) AS (VALUES " + ", ".join(
    f"({q(w)}, {v})" for w, v in lexicon.VALENCES.items()) + ")"
SENTENCES = "sent AS (SELECT doc_id, sent_no, min(b) AS b, max(e) AS e FROM tok GROUP BY ALL)"
SENTENCE_SCORES = (
    VALENCE + """,
sscore AS (SELECT doc_id, sent_no, round(avg(v) / 5.0, 6) AS score FROM tok JOIN val USING (term) GROUP BY ALL),
dscore AS (SELECT doc_id, round(avg(v) / 5.0, 6) AS score FROM tok JOIN val USING (term) GROUP BY ALL)""")


def rule_values(rules: list[dict]) -> str:
    rows = []
    for i, r in enumerate(rules):
        f = r["filters"] or {}
        s = f.get("sentiment") or {}
        need = [t for e in f.get("requireEntity") or [] for t in e["types"]]

        def num(v: float | None) -> str:
            return "NULL::DOUBLE" if v is None else f"{v}::DOUBLE"

        rows.append(
            f"({i}, {q(r['id'])}, {q(r['type'])}, {q(r['match'])}, {bool(r['lemma'])}, {bool(r['stem'])}, "
            f"{r['enabled'] is not False}, {sql_list(f.get('pos') or [])}, {sql_list(need)}, {bool(s)}, "
            f"{num(s.get('min'))}, {num(s.get('max'))}, {q(s.get('scope') or 'sentence')}, {sql_list(r['tags'])})")
    return ("R(rule_no, id, type, m, is_lemma, is_stem, enabled, rpos, need, has_sent, smin, smax, scope, tags) AS "
            "(VALUES " + ",\n  ".join(rows) + ")")


KINDS = ("pattern", "keyword", "literal", "entity")


def matches_of(source: str, grams: list[int] = (2, 3), kinds: tuple[str, ...] = KINDS) -> str:
    """Every match of the rules in R of some ``kinds`` over ``source``; needs R, tok (patterns, keywords) and ent (entities)."""
    before: list[str] = []
    matches: list[str] = []
    if "pattern" in kinds:
        leads = ", ".join(
            f"lead(pos, {i}) OVER w AS p{i}, lead(surface, {i}) OVER w AS s{i}, lead(e, {i}) OVER w AS e{i}"
            for i in range(max(grams)))
        before.append(f"grams AS (SELECT doc_id, b, {leads} FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY tok_no))")
        for n in grams:
            before.append(f"gram{n} AS (SELECT doc_id, b, e{n - 1} AS e, " + " || ' ' || ".join(f"s{i}" for i in range(n)) + " AS txt, "
                          + " || ' ' || ".join(f"p{i}" for i in range(n)) + " AS shape FROM grams)")
            matches.append(f"SELECT doc_id, rule_no, id, txt, b, e, string_split(m, ' ') AS tags_ FROM gram{n} JOIN R ON shape = m WHERE type = 'pattern'")
    if "keyword" in kinds:
        before.append("stemmed AS (" + stems_of("SELECT DISTINCT term FROM tok WHERE EXISTS (FROM R WHERE type = 'keyword' AND is_stem AND NOT is_lemma)") + ")")
        said = "SELECT doc_id, rule_no, id, surface AS txt, b, e, [pos] AS tags_ FROM tok"
        matches += [
            f"{said} JOIN R ON lower(lemma) = lower(m) WHERE type = 'keyword' AND is_lemma",
            f"{said} JOIN R ON term = lower(m) WHERE type = 'keyword' AND NOT is_lemma AND NOT is_stem",
            f"{said} JOIN stemmed USING (term) JOIN R ON stem = m WHERE type = 'keyword' AND is_stem AND NOT is_lemma"]
    if "literal" in kinds:
        before.append(f"""parts AS (
  SELECT doc_id, rule_no, id, length(m) AS len, unnest(a) AS part, generate_subscripts(a, 1) AS i, len(a) AS n
  FROM (SELECT doc_id, rule_no, id, m, string_split(lower(text), lower(m)) AS a
        FROM {source} JOIN R ON type = 'literal' AND contains(lower(text), lower(m)))),
lits AS (
  SELECT doc_id, rule_no, id, len, i, n,
    sum(length(part)) OVER (PARTITION BY doc_id, rule_no ORDER BY i) + (i - 1) * len AS b FROM parts)""")
        matches.append(f"""SELECT lits.doc_id, rule_no, id, substring(text, (b + 1)::BIGINT, len) AS txt, b, b + len AS e, NULL::VARCHAR[] AS tags_
  FROM lits JOIN {source} USING (doc_id) WHERE i < n""")
    if "entity" in kinds:
        matches.append("SELECT doc_id, rule_no, id, surface AS txt, b, e, NULL::VARCHAR[] AS tags_ FROM ent JOIN R ON ent.type = m WHERE R.type = 'entity'")
    return ",\n".join([*before, "M AS (\n  " + "\n  UNION ALL\n  ".join(matches) + ")"])


def stems_of(terms: str) -> str:
    """(term, stem) of a query of terms by Porter's steps, each a subquery that adds the next form of the word."""
    shape = """list_reduce(list_prepend('', string_split(w, '')), lambda a, ch:
      a || CASE WHEN ch IN ('a', 'e', 'i', 'o', 'u') OR (ch = 'y' AND right(a, 1) = 'c') THEN 'v' ELSE 'c' END)"""
    m = lambda k: f"len(regexp_extract_all(left(s, (length(w) - {k})::BIGINT), 'v+c+'))"
    vowel = lambda k: f"contains(left(s, length(w) - {k}), 'v')"
    cut = lambda k: f"left(w, (length(w) - {k})::BIGINT)"
    cvc = lambda k: f"(right({cut(k).replace('w', 's', 1)}, 3) = 'cvc' AND right({cut(k)}, 1) NOT IN ('w', 'x', 'y'))"

    def longest(endings: list[str]) -> str:
        return "regexp_extract(w, '(?:" + "|".join(endings) + ")$')"

    def table(endings: dict[str, str]) -> str:
        to = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in endings.items())
        end = longest(list(endings))
        return f"CASE WHEN {end} <> '' AND {m(f'length({end})')} > 0 THEN {cut(f'length({end})')} || CASE {end} {to} END ELSE w END"

    fourth = longest(lang._STEP4)
    steps = [
        f"CASE WHEN regexp_matches(w, '(?:sses|ies)$') THEN {cut(2)} WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN {cut(1)} ELSE w END",
        f"""CASE WHEN w LIKE '%eed' THEN CASE WHEN {m(3)} > 0 THEN {cut(1)} ELSE w END
             WHEN w LIKE '%ed' AND {vowel(2)} THEN '+' || {cut(2)} WHEN w LIKE '%ing' AND {vowel(3)} THEN '+' || {cut(3)} ELSE w END""",
        # a plus marks words that have lost their ending; its shape is a consonant's, and goes with it
        f"""CASE WHEN w NOT LIKE '+%' THEN w WHEN regexp_matches(w, '(?:at|bl|iz)$') THEN w[2:] || 'e'
             WHEN length(w) > 2 AND w[-1] = w[-2] AND right(s, 1) = 'c' AND w[-1] NOT IN ('l', 's', 'z') THEN w[2:-2]
             WHEN len(regexp_extract_all(s, 'v+c+')) = 1 AND s LIKE '%cvc' AND w[-1] NOT IN ('w', 'x', 'y') THEN w[2:] || 'e' ELSE w[2:] END""",
        f"CASE WHEN w LIKE '%y' AND {vowel(1)} THEN {cut(1)} || 'i' ELSE w END",
        table(lang._STEP2),
        table(lang._STEP3),
        f"CASE WHEN {fourth} <> '' AND {m(f'length({fourth})')} > 1 AND ({fourth} <> 'ion' OR regexp_matches(w, '[st]ion$')) THEN {cut(f'length({fourth})')} ELSE w END",
        f"CASE WHEN w LIKE '%e' AND ({m(1)} > 1 OR ({m(1)} = 1 AND NOT {cvc(1)})) THEN {cut(1)} ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {m(0)} > 1 THEN {cut(1)} ELSE w END",
    ]
    out = f"SELECT term, term AS w FROM ({terms}) WHERE regexp_full_match(term, '[a-z]{{3,}}')"
    for i, step in enumerate(steps):
        of = shape if i != 2 else shape.replace("string_split(w, '')", "string_split(ltrim(w, '+'), '')")
        out = f"SELECT term, {step} AS w FROM (SELECT term, w, {of} AS s FROM ({out}))"
    return f"SELECT term, w AS stem FROM ({out}) UNION ALL SELECT term, term FROM ({terms}) WHERE NOT regexp_full_match(term, '[a-z]{{3,}}')"


FILTERED = """
dtypes AS (SELECT doc_id, list(DISTINCT type) AS types FROM ent GROUP BY doc_id),
located AS (
  SELECT M.*, sent.sent_no AS unit FROM M JOIN R USING (rule_no) LEFT JOIN sent
    ON sent.doc_id = M.doc_id AND M.b >= sent.b AND M.b < sent.e WHERE has_sent),
dmean AS (
  SELECT sent.doc_id, round(sum(coalesce(score, 0)) / count(*), 6) AS score
  FROM sent LEFT JOIN sscore USING (doc_id, sent_no) GROUP BY ALL),
scored AS (
  SELECT l.doc_id, l.rule_no, l.b, l.e,
    CASE WHEN unit IS NULL THEN coalesce(dmean.score, 0) ELSE coalesce(sscore.score, 0) END AS score
  FROM located l LEFT JOIN sscore ON sscore.doc_id = l.doc_id AND sscore.sent_no = l.unit
  LEFT JOIN dmean ON dmean.doc_id = l.doc_id),
K AS (
  SELECT M.* FROM M JOIN R USING (rule_no)
  LEFT JOIN dtypes ON dtypes.doc_id = M.doc_id
  LEFT JOIN scored ON scored.doc_id = M.doc_id AND scored.rule_no = M.rule_no AND scored.b = M.b AND scored.e = M.e
  WHERE enabled
    AND (len(rpos) = 0 OR (tags_ IS NOT NULL AND list_has_any(tags_, rpos)))
    AND (len(need) = 0 OR coalesce(list_has_any(need, types), false))
    AND (NOT has_sent OR (coalesce(score >= smin, true) AND coalesce(score <= smax, true)))),
H AS (SELECT DISTINCT doc_id, rule_no FROM K)"""

EXPECTED = """
hit_rules AS (
  SELECT doc_id, string_agg(R.id, ' ' ORDER BY rule_no) AS matched_rules FROM H JOIN R USING (rule_no) GROUP BY doc_id),
hit_tags AS (
  SELECT doc_id, tag, min(rule_no * 1000 + pos_) AS ord
  FROM (SELECT doc_id, rule_no, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos_ FROM H JOIN R USING (rule_no))
  GROUP BY ALL)"""

FENCE = re2(r"(?ms)^```.*?\n```[^\n]*")
TAG = q(r"#([a-zA-Z0-9\-_/]+)")


def existing_of(source: str) -> str:
    return f"""
found AS (
  SELECT doc_id, unnest(a) AS tag, generate_subscripts(a, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, {FENCE}, '', 'g'), {TAG}, 1) AS a FROM {source})),
E AS (SELECT doc_id, tag, min(i) AS ord FROM found GROUP BY ALL)"""


DIFF = """
managed AS (SELECT DISTINCT unnest(tags) AS tag FROM R WHERE enabled),
removed AS (
  SELECT doc_id, tag, ord FROM E WHERE tag IN (SELECT tag FROM managed)
    AND NOT EXISTS (SELECT 1 FROM hit_tags t WHERE t.doc_id = E.doc_id AND t.tag = E.tag)),
added AS (
  SELECT doc_id, tag, ord FROM hit_tags t
  WHERE NOT EXISTS (SELECT 1 FROM E WHERE t.doc_id = E.doc_id AND t.tag = E.tag)),
D AS (
  SELECT N.doc_id, N.source, N.text, coalesce(a.tags, '') AS added, coalesce(r.tags, '') AS removed,
    coalesce(a.n, 0) AS n_added, coalesce(r.n, 0) AS n_removed,
    coalesce(matched_rules, '') AS matched_rules, (a.n IS NOT NULL OR r.n IS NOT NULL) AS modified
  FROM N LEFT JOIN hit_rules USING (doc_id)
  LEFT JOIN (SELECT doc_id, string_agg(tag, ' ' ORDER BY ord) AS tags, count(*) AS n FROM added GROUP BY doc_id) a USING (doc_id)
  LEFT JOIN (SELECT doc_id, string_agg(tag, ' ' ORDER BY ord) AS tags, count(*) AS n FROM removed GROUP BY doc_id) r USING (doc_id))"""


def squeeze(expr: str) -> str:
    return f"regexp_replace({expr}, '{WS}+\\n', {NL}, 'g')"


def without_tags(expr: str, names: str) -> str:
    """Cut ``#name`` where no tag character follows; the next character is put back."""
    return f"regexp_replace({expr}, '#(?:' || {names} || ')([^a-zA-Z0-9\\-_/]|\\z)', '\\1', 'g')"


def insertion(source: str, tags: str) -> str:
    """CTEs ending in ``ins(doc_id, text)``: ``tags`` ('#a #b' per row, '' for none) inserted."""
    tag_line = rf"^#[a-zA-Z0-9\-_/]+(?:{WS}+#[a-zA-Z0-9\-_/]+)*{WS}*\z"
    return lines_of("L", source) + f""",
spots AS (
  SELECT L.doc_id, max(fm) AS fm, max(i) AS n,
    coalesce(max(CASE WHEN i > fm AND regexp_matches({trim('line')}, '{tag_line}') THEN i END), 0) AS tag_i,
    coalesce(max(CASE WHEN {trim('line')} <> '' THEN i END), 0) AS text_i
  FROM L JOIN L_fm USING (doc_id) GROUP BY L.doc_id),
opened AS (
  SELECT L.doc_id, i * 10 AS i, CASE WHEN i = tag_i AND t.tags <> '' THEN {trim('line')} || ' ' || t.tags ELSE line END AS line
  FROM L JOIN spots USING (doc_id) JOIN (SELECT doc_id, {tags} AS tags FROM {source}) t USING (doc_id)
  UNION ALL
  SELECT doc_id, text_i * 10 + k, CASE WHEN k = 1 THEN '' ELSE t.tags END
  FROM spots JOIN (SELECT doc_id, {tags} AS tags FROM {source}) t USING (doc_id), (VALUES (1), (2)) v(k)
  WHERE tag_i = 0 AND t.tags <> ''),
ins AS (SELECT doc_id, string_agg(line, {NL} ORDER BY i) AS text FROM opened GROUP BY doc_id)"""


def with_blocks(*blocks: str, select: str) -> str:
    return "WITH " + ",\n".join(b.strip() for b in blocks) + "\n" + select


_R = rule_values(fx.RULES)
_ON_DOCUMENTS = (tokens_of("documents"), entities_of("documents"), SENTENCES, SENTENCE_SCORES, _R,
                 matches_of("documents"), FILTERED)
_ON_NOTES = (NOTES, tokens_of("N"), entities_of("N"), SENTENCES, SENTENCE_SCORES, _R, matches_of("N"), FILTERED,
             EXPECTED, existing_of("N"), DIFF)


def _on_documents(rules: list[dict], grams: list[int] = (2, 3)) -> tuple[str, ...]:
    return (tokens_of("documents"), entities_of("documents"), SENTENCES, SENTENCE_SCORES, rule_values(rules),
            matches_of("documents", grams), FILTERED)


_SQL: dict[str, str] = {}

# --- Markdown functions -----------------------------------------------------------

_first = f"string_split(text, {NL})[1]"
_SQL["q01_slug_title"] = f"""
WITH s AS (
  SELECT doc_id, {trim(_first)} AS title,
    {trim(f"regexp_replace(lower({_first}), '[^a-z0-9{WS_CHARS}]', '', 'g')")} AS kept FROM documents)
SELECT doc_id, title, CASE WHEN kept = '' THEN 'note'
  ELSE array_to_string(regexp_split_to_array(kept, '{WS}+')[1:5], '-') END AS slug FROM s"""

_SQL["q02_frontmatter_lines"] = with_blocks(NOTES, lines_of("L", "N"), select=f"""
SELECT L.doc_id, max(fm) AS fm_lines, sha256(string_agg(line, {NL} ORDER BY i) FILTER (i > fm)) AS body_hash
FROM L JOIN L_fm USING (doc_id) GROUP BY L.doc_id""")

_SQL["q03_strip_fences"] = with_blocks(NOTES, select=f"""
SELECT doc_id, sha256(regexp_replace(text, {FENCE}, '', 'g')) AS text_hash FROM N""")

_SQL["q04_existing_tags"] = with_blocks(NOTES, existing_of("N"), select="""
SELECT N.doc_id, coalesce(string_agg(tag, ' ' ORDER BY ord), '') AS tags
FROM N LEFT JOIN E USING (doc_id) GROUP BY N.doc_id""")

_SQL["q05_insert_tags"] = with_blocks(NOTES, insertion("N", "'#alpha #beta/x'"), select="""
SELECT doc_id, sha256(text) AS text_hash FROM ins""")

_removed = without_tags("text", "'stale|quality/0|lang/de|lang'")
_SQL["q06_remove_tags"] = with_blocks(NOTES, select=f"""
SELECT doc_id, sha256(regexp_replace({squeeze(_removed)}, '\\n+\\z', {NL})) AS text_hash FROM N""")

_SQL["q06b_remove_tags_compat"] = with_blocks(NOTES, select=f"""
SELECT doc_id, sha256(regexp_replace({squeeze(
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '#stale\\b', '', 'g'), "
    "'#quality/0\\b', '', 'g'), '#lang/de\\b', '', 'g'), '#lang\\b', '', 'g')")},
  '\\n+\\z', {NL})) AS text_hash FROM N""")

_SQL["q37_content_hash"] = "SELECT doc_id, sha256(text) AS text_hash FROM documents"

# --- Annotation -------------------------------------------------------------------

_SQL["q07_token_counts"] = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, {re2(lang.TOKEN)}) AS a FROM documents)
SELECT doc_id, len(a) AS n_tokens, len(list_distinct(a)) AS n_distinct FROM t"""

_SQL["q07b_token_offsets"] = with_blocks(tokens_of("documents"), select="""
SELECT doc_id, sum(b)::BIGINT AS sum_begin, sum(e)::BIGINT AS sum_end, max(tok_no) AS last_token,
  sum(CASE WHEN regexp_matches(surface, '^[A-Z]') THEN b ELSE 0 END)::BIGINT AS sum_capital_begin
FROM tok GROUP BY doc_id""")

_SQL["q08_sentence_counts"] = with_blocks(tokens_of("documents"), SENTENCES, select="""
SELECT doc_id, count(*) AS n_sentences, sum(b)::BIGINT AS sum_begin, sum(e)::BIGINT AS sum_end,
  max(e - b)::BIGINT AS longest FROM sent GROUP BY doc_id""")

_SQL["q09_paragraphs"] = with_blocks(NOTES, f"""
cut AS (
  SELECT doc_id, unnest(a) AS piece, generate_subscripts(a, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '(?s)(?:.*?(?:\\n{WS}*\\n)|.+?\\z)') AS a FROM N)),
paras AS (
  SELECT doc_id, i, regexp_replace(piece, '\\n{WS}*\\n\\z', '') AS text,
    coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM cut)""", select=f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS para_no, b::BIGINT AS p_begin,
  (b + length(text))::BIGINT AS p_end, sha256(text) AS text_hash
FROM paras WHERE {trim('text')} <> ''""")

_SQL["q10_pos_histogram"] = with_blocks(tokens_of("documents"), select="""
SELECT pos, count(*) AS n FROM tok GROUP BY pos""")

_SQL["q11_lemma_counts"] = with_blocks(tokens_of("documents"), select="""
SELECT lemma, count(*) AS n FROM tok GROUP BY lemma""")

_SQL["q12_stem_vocab"] = with_blocks(
    "lowered AS (SELECT doc_id, lower(text) AS text FROM documents)", tokens_of("lowered"),
    "terms AS (SELECT DISTINCT surface AS term FROM tok)", select=stems_of("SELECT term FROM terms"))
_SQL["q13_entities_by_type"] = with_blocks(entities_of("documents"), select="""
SELECT type, count(*) AS n, count(DISTINCT doc_id) AS n_docs, sum(b)::BIGINT AS sum_begin FROM ent GROUP BY type""")

_SQL["q13b_page_entities"] = with_blocks(
    "src AS (SELECT page_id AS doc_id, html AS text FROM pages)", entities_of("src"), select="""
SELECT type, count(*) AS n, count(DISTINCT doc_id) AS n_docs, sum(b)::BIGINT AS sum_begin FROM ent GROUP BY type""")

_SQL["q14_sentence_sentiment"] = with_blocks(tokens_of("documents"), SENTENCES, SENTENCE_SCORES, select="""
SELECT doc_id, sent_no::BIGINT AS sent_no, coalesce(score, 0) AS score FROM sent LEFT JOIN sscore USING (doc_id, sent_no)""")

_SQL["q14b_document_sentiment"] = with_blocks(tokens_of("documents"), SENTENCES, SENTENCE_SCORES, """
means AS (SELECT doc_id, round(sum(coalesce(score, 0)) / count(*), 6) AS mean_score
          FROM sent LEFT JOIN sscore USING (doc_id, sent_no) GROUP BY doc_id)""", select="""
SELECT d.doc_id, coalesce(mean_score, 0) AS mean_score, coalesce(score, 0) AS whole_score
FROM documents d LEFT JOIN means USING (doc_id) LEFT JOIN dscore USING (doc_id)""")

# --- Matchers ---------------------------------------------------------------------

_MATCH_ROWS = "SELECT doc_id, id AS rule_id, txt AS match_text, b::BIGINT AS m_begin, e::BIGINT AS m_end FROM M"

def _matches(kind: str, select: str) -> str:
    """Matches of one kind of rule, from the blocks it needs."""
    needs = {"pattern": [tokens_of("documents")], "keyword": [tokens_of("documents")], "literal": [], "entity": [entities_of("documents")]}
    return with_blocks(*needs[kind], _R, matches_of("documents", kinds=(kind,)), select=select)


_SQL["q15_pattern_matches"] = _matches("pattern", """
SELECT doc_id, id AS rule_id, txt AS match_text, b::BIGINT AS m_begin, e::BIGINT AS m_end, array_to_string(tags_, ' ') AS pos_tags FROM M""")
_SQL["q16_keyword_matches"] = _matches("keyword", f"{_MATCH_ROWS} WHERE rule_no IN (SELECT rule_no FROM R WHERE enabled)")
_SQL["q17_literal_matches"] = _matches("literal", _MATCH_ROWS)
_SQL["q17b_literal_counts"] = with_blocks(_R, select="""
SELECT doc_id, id AS rule_id,
  ((length(lower(text)) - length(replace(lower(text), lower(m), ''))) / length(m))::BIGINT AS n
FROM documents JOIN R ON type = 'literal' AND contains(lower(text), lower(m))""")
_SQL["q17c_many_phrases"] = """
SELECT doc_id, item_id AS rule_no, lower(b.text) AS phrase
FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))"""
_SQL["q18_entity_matches"] = _matches("entity", _MATCH_ROWS)


def _legacy_terms() -> str:
    rows = []
    for no, keyword, variations, cased, _ in fx.LEGACY_KEYWORDS:
        for term in [keyword, *(variations or [])]:
            escaped = term.replace(".", "\\.")
            pattern = ("" if cased else "(?i)") + rf"\b{escaped}\b"
            rows.append(f"({no}, {q(keyword)}, {q(pattern)})")
    return "T(keyword_no, keyword, pattern) AS (VALUES " + ", ".join(rows) + ")"


_LEGACY = (
    NOTES, lines_of("L", "N"), f"""
body AS (SELECT L.doc_id, string_agg(line, {NL} ORDER BY i) FILTER (i > fm) AS text FROM L JOIN L_fm USING (doc_id) GROUP BY L.doc_id),
prose AS (SELECT doc_id, regexp_replace(text, {FENCE}, '', 'g') AS text FROM body)""", _legacy_terms(), """
KH AS (SELECT DISTINCT doc_id, keyword_no, keyword FROM prose JOIN T ON regexp_matches(text, pattern))""")

_SQL["q19_legacy_keywords"] = with_blocks(*_LEGACY, select="SELECT doc_id, keyword FROM KH")

_keyword_rules = "R(rule_no, id, enabled, tags) AS (VALUES " + ", ".join(
    f"({no}, {q(k)}, true, {sql_list(tags)})" for no, k, _, _, tags in fx.LEGACY_KEYWORDS) + ")"
_SQL["q19b_legacy_reconcile"] = with_blocks(
    *_LEGACY, _keyword_rules, "H AS (SELECT doc_id, keyword_no AS rule_no FROM KH)", EXPECTED, existing_of("N"), DIFF,
    select="SELECT doc_id, modified, added, matched_rules AS matched_keywords FROM D")

# --- Filters ----------------------------------------------------------------------


def _kept(*ids: str) -> str:
    chosen = f"WHERE id IN {in_list(list(ids))}" if ids else ""
    return f"SELECT doc_id, id AS rule_id, count(*) AS n FROM K {chosen} GROUP BY ALL"


_SQL["q20_pos_filter"] = with_blocks(*_ON_DOCUMENTS, select=_kept("r02", "r09", "r12"))
_SQL["q21_entity_filter"] = with_blocks(*_ON_DOCUMENTS, select=_kept("r03", "r10"))
_SQL["q23_sentiment_filter"] = with_blocks(*_ON_DOCUMENTS, select=_kept("r11"))

# No documents row holds a blank line, so a paragraph is the whole text trimmed of nothing.
_PARAGRAPH = """
unit_of AS (
  SELECT M.*, sent.sent_no FROM M LEFT JOIN sent ON sent.doc_id = M.doc_id AND M.b >= sent.b AND M.b < sent.e)"""

_SQL["q22_entity_filter_scoped"] = with_blocks(*_on_documents(fx.ENTITY_SCOPE_RULES), _PARAGRAPH, """
es AS (SELECT ent.doc_id, type, sent_no FROM ent LEFT JOIN sent
       ON sent.doc_id = ent.doc_id AND ent.b >= sent.b AND ent.b < sent.e)""", select="""
SELECT doc_id, id AS rule_id, count(*) AS n FROM unit_of u WHERE
  CASE id
    WHEN 'e1' THEN EXISTS (SELECT 1 FROM es WHERE es.doc_id = u.doc_id AND es.sent_no = u.sent_no AND type IN ('CARDINAL', 'EMAIL'))
    WHEN 'e2' THEN EXISTS (SELECT 1 FROM es WHERE es.doc_id = u.doc_id AND type = 'CARDINAL')
    WHEN 'e3' THEN EXISTS (SELECT 1 FROM es WHERE es.doc_id = u.doc_id AND type = 'EMAIL')
      OR EXISTS (SELECT 1 FROM es WHERE es.doc_id = u.doc_id AND es.sent_no = u.sent_no AND type = 'PERCENT')
  END GROUP BY ALL""")

_SQL["q23b_sentiment_scopes"] = with_blocks(*_on_documents(fx.SCOPED_RULES), _PARAGRAPH, """
sc AS (
  SELECT u.doc_id, u.id, u.rule_no, CASE WHEN id IN ('s1', 's2') THEN coalesce(dscore.score, 0)
    ELSE coalesce(sscore.score, 0) END AS score
  FROM unit_of u LEFT JOIN dscore USING (doc_id)
  LEFT JOIN sscore ON sscore.doc_id = u.doc_id AND sscore.sent_no = u.sent_no)""", select="""
SELECT doc_id, sc.id AS rule_id, count(*) AS n FROM sc JOIN R USING (rule_no)
WHERE coalesce(score >= smin, true) AND coalesce(score <= smax, true) GROUP BY ALL""")

# --- Tagging ----------------------------------------------------------------------

_SQL["q24_expected_tags"] = with_blocks(*_ON_DOCUMENTS, EXPECTED, select="""
SELECT doc_id, matched_rules, string_agg(tag, ' ' ORDER BY ord) AS expected
FROM hit_rules JOIN hit_tags USING (doc_id) GROUP BY ALL""")

_SQL["q24b_expected_tags_by_matches"] = _SQL["q24_expected_tags"]

_DIFF_ROWS = "SELECT doc_id, modified, added, removed, matched_rules FROM D"
_SQL["q25_tag_diff"] = with_blocks(*_ON_NOTES, select=_DIFF_ROWS)
_SQL["q25c_tag_diff_by_joins"] = _SQL["q25_tag_diff"]
_SQL["q25b_tag_diff_map_only"] = with_blocks(
    *_ON_NOTES, select=_DIFF_ROWS).replace(f"\n{_R}", "\n" + rule_values(
        [r | {"enabled": r["enabled"] if r["id"] != "r11" else False} for r in fx.RULES]))

_names = "regexp_replace(replace(removed, ' ', '|'), '([.+])', '\\\\\\1', 'g')"
_REWRITE = f"""
W AS (
  SELECT doc_id, CASE WHEN n_added = 0 THEN '' ELSE '#' || replace(added, ' ', ' #') END AS tag_text,
    CASE WHEN n_removed = 0 THEN text
      ELSE regexp_replace({squeeze(without_tags('text', _names))}, '\\n+\\z', {NL}) END AS text
  FROM D WHERE modified)"""
_SQL["q26_reconciled_text"] = with_blocks(*_ON_NOTES, _REWRITE, insertion("W", "tag_text"), select="""
SELECT doc_id, sha256(text) AS text_hash FROM ins""")

# Rules without positions; a note is acted on once, and its rewrite comes back once.
_SQL["q43_echo_loop"] = with_blocks(*_ON_NOTES, _REWRITE, insertion("W", "tag_text"), select="""
SELECT N.doc_id, (1 + (ins.doc_id IS NOT NULL)::INT)::BIGINT AS n_versions, 1::BIGINT AS n_acted, sha256(coalesce(ins.text, N.text)) AS text_hash
FROM N LEFT JOIN ins ON N.doc_id = ins.doc_id""").replace(f"\n{_R}", "\n" + rule_values(
    [r | {"enabled": r["enabled"] if r["id"] != "r11" else False} for r in fx.RULES]))

# Everything; what was edited since; everything again under other rules.
_SQL["q45_incremental_sync"] = f"""SELECT doc_id, modified, CASE lang WHEN 'de' THEN '1 2 4' ELSE '1 4' END AS runs
FROM ({_SQL["q25b_tag_diff_map_only"]}) JOIN documents USING (doc_id)"""

_SUMMARY = """count(*) AS processed, count_if(modified)::BIGINT AS modified,
  sum(n_added)::BIGINT AS tags_added, sum(n_removed)::BIGINT AS tags_removed FROM D"""
_SQL["q27_sync_summary"] = with_blocks(*_ON_NOTES, select=f"SELECT {_SUMMARY}")
_SQL["q27b_sync_summary_by_alias"] = with_blocks(
    *_ON_NOTES, select=f"SELECT source AS alias, {_SUMMARY} GROUP BY source")

_MIGRATED = f"""
C AS (SELECT doc_id, {without_tags('text', "'stale|lang/fr'")} AS text FROM N
      WHERE regexp_matches(text, '#(?:stale|lang/fr)(?:[^a-zA-Z0-9\\-_/]|\\z)'))"""
_SQL["q28_migrate_tags"] = with_blocks(NOTES, _MIGRATED, existing_of("C"), """
A AS (SELECT C.doc_id, C.text, coalesce((
        SELECT string_agg('#' || tag, ' ' ORDER BY k) FROM (VALUES (1, 'archived'), (2, 'quality/1')) v(k, tag)
        WHERE NOT EXISTS (SELECT 1 FROM E WHERE E.doc_id = C.doc_id AND E.tag = v.tag)), '') AS tag_text FROM C)""",
    insertion("A", "tag_text"), select="SELECT doc_id, sha256(text) AS text_hash FROM ins")

_cut_bulk = without_tags("text", "'stale|quality/1'")
_SQL["q29_bulk_remove"] = with_blocks(NOTES, select=f"""
SELECT doc_id, sha256({squeeze(f"regexp_replace({_cut_bulk}, '\\n{WS}*\\n{WS}*\\z', {NL})")}) AS text_hash
FROM N WHERE regexp_matches(text, '#(?:stale|quality/1)(?:[^a-zA-Z0-9\\-_/]|\\z)')""")

_SQL["q30_rule_coverage"] = with_blocks(*_ON_DOCUMENTS, select="""
SELECT id AS rule_id, count(*) AS match_count FROM H JOIN R USING (rule_no) GROUP BY id""")

# Two runs over the same documents, the second of them done twice.
_SQL["q46_statistics_over_runs"] = with_blocks(*_ON_DOCUMENTS, select="""
SELECT id AS rule_id, 2 * count(*) AS match_count FROM H JOIN R USING (rule_no) GROUP BY id""").replace(f"\n{_R}", "\n" + rule_values(
    [r | {"enabled": r["enabled"] if r["id"] != "r11" else False} for r in fx.RULES]))

# --- Discovery --------------------------------------------------------------------

_CONTENT = """
content AS (SELECT doc_id, tok_no, lower(lemma) AS keyword FROM tok
            WHERE pos IN ('NOUN', 'VERB', 'ADJ', 'PROPN') AND length(lemma) > 2)"""
_SQL["q31_top_keywords"] = with_blocks(tokens_of("documents"), _CONTENT, select="""
SELECT keyword, count(*) AS n, count(DISTINCT doc_id) AS file_count FROM content
GROUP BY keyword ORDER BY n DESC, keyword LIMIT 50""")
_SQL["q31b_keyword_samples"] = with_blocks(tokens_of("documents"), _CONTENT, """
best AS (SELECT keyword FROM content GROUP BY keyword ORDER BY count(*) DESC, keyword LIMIT 20),
held AS (SELECT DISTINCT keyword, doc_id FROM content JOIN best USING (keyword)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY doc_id) AS r FROM held)""", select="""
SELECT keyword, string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) AS sample_files FROM ranked WHERE r <= 5 GROUP BY keyword""")
_SQL["q32_top_phrases"] = with_blocks(tokens_of("documents"), """
pairs AS (SELECT doc_id, pos, lead(pos) OVER w AS pos2, lower(surface || ' ' || lead(surface) OVER w) AS phrase
          FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY tok_no))""", select="""
SELECT phrase, count(*) AS n, count(DISTINCT doc_id) AS file_count FROM pairs WHERE pos = 'DET' AND pos2 = 'NOUN'
GROUP BY phrase ORDER BY n DESC, phrase LIMIT 50""")
_SQL["q33_concordance"] = with_blocks(tokens_of("documents"), select="""
SELECT doc_id, tok_no, surface FROM tok WHERE lower(lemma) = 'clown' ORDER BY doc_id, tok_no LIMIT 50""")
_SQL["q33b_concordance_total"] = with_blocks(tokens_of("documents"), select="""
SELECT count(*) AS n, count(DISTINCT doc_id) AS file_count FROM tok WHERE term = 'the'""")
_SQL["q33c_concordance_per_document"] = with_blocks(tokens_of("documents"), """
r AS (SELECT doc_id, tok_no, surface, row_number() OVER (PARTITION BY doc_id ORDER BY tok_no) AS rank
      FROM tok WHERE term = 'the')""", select="SELECT * FROM r WHERE rank <= 3")
_SQL["q34_rule_preview"] = with_blocks(*_ON_DOCUMENTS[:6], """
chosen AS (SELECT * FROM M WHERE id IN ('r01', 'r03', 'r05', 'r08')),
counts AS (SELECT id, count(*) AS match_count FROM chosen GROUP BY id),
s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id, b, e) AS sample_no FROM chosen)""", select=f"""
SELECT s.id AS rule_id, sample_no, s.doc_id::VARCHAR AS path, txt AS match_text,
  len(string_split(substring(text, 1, b::BIGINT), {NL})) AS line,
  string_split(text, {NL})[len(string_split(substring(text, 1, b::BIGINT), {NL}))] AS context, match_count
FROM s JOIN documents USING (doc_id) JOIN counts USING (id) WHERE sample_no <= 5""")

# --- Rule sets --------------------------------------------------------------------

_IMPORTED = """
src AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rule_no, ['keyword', 'literal', 'pattern', 'entity', 'regex'][doc_id % 5 + 1] AS type,
    CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE lang || ' ' || source END AS m, lang,
    doc_id % 13 = 0 AS no_tags, doc_id % 17 = 0 AS lemma, doc_id % 2 = 0 AS stem,
    CASE WHEN doc_id % 19 = 0 THEN NULL ELSE round((doc_id % 31) / 10.0 - 1.5, 1) END AS smin
  FROM documents),
checked AS (
  SELECT *, list_filter([
    CASE WHEN type = 'regex' THEN 'type is unknown' END,
    CASE WHEN m = '  ' THEN 'match is blank' END,
    CASE WHEN no_tags THEN 'no tags' END,
    CASE WHEN type = 'keyword' AND lemma AND stem THEN 'lemma and stem' END,
    CASE WHEN smin IS NULL OR smin < -1 OR smin > 1 THEN 'sentiment min outside [-1, 1]' END], lambda x: x IS NOT NULL) AS errors
  FROM src)"""
_SQL["q35_rule_import"] = with_blocks(_IMPORTED, """
based AS (
  SELECT *, type || '-' || substring(regexp_replace(regexp_replace(lower(m), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 50) AS base
  FROM checked WHERE len(errors) = 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS k FROM based)""", select="""
SELECT rule_no, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS id, type, m AS match,
  lang AS tags, smin::DOUBLE AS sentiment_min, true AS is_fresh FROM numbered""")
_SQL["q35b_rule_quarantine"] = with_blocks(_IMPORTED, select="""
SELECT rule_no, array_to_string(errors, '; ') AS errors FROM checked WHERE len(errors) > 0""")
_MERGED = """
fresh AS (SELECT source AS name, arg_max(lang, doc_id) AS description FROM documents GROUP BY source),
stored AS (SELECT DISTINCT source AS name FROM documents WHERE lang = 'de' UNION ALL SELECT 'stored only'),
merged AS (SELECT coalesce(s.name, f.name) AS name, coalesce(f.description, 'old') AS description,
             CASE WHEN f.name IS NULL THEN NULL WHEN s.name IS NULL THEN 'added' ELSE 'overwritten' END AS outcome
           FROM stored s FULL JOIN fresh f ON s.name = f.name)"""
_SQL["q47_merge_groups"] = f"WITH {_MERGED} SELECT * FROM merged"
_SQL["q47b_import_counts"] = with_blocks(_IMPORTED, _MERGED, select="""
SELECT 'rule' AS kind, CASE WHEN len(errors) = 0 THEN 'imported' ELSE 'skipped' END AS outcome, count(*) AS n FROM checked GROUP BY ALL
UNION ALL SELECT 'group', outcome, count(*) FROM merged WHERE outcome IS NOT NULL GROUP BY ALL""")
_SQL["q36_group_effects"] = """
SELECT 'k' || doc_id AS id, (doc_id % 7 <> 0 AND doc_id % 10 <> 0) AS enabled,
  lang || CASE WHEN doc_id % 2 = 0 AND lang <> 'en' THEN ' en' ELSE '' END
       || CASE WHEN doc_id % 2 = 0 THEN ' review' ELSE '' END
       || CASE WHEN doc_id % 3 = 0 THEN ' third' ELSE '' END AS tags FROM documents"""
_SQL["q36b_select_rules"] = "SELECT 'k' || doc_id AS id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 7 <> 0"

# --- Change streams ---------------------------------------------------------------

_SQL["q38_changed_only"] = """
SELECT event_id, user_id, event_type FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
WHERE before IS DISTINCT FROM event_type"""
_SQL["q39_debounce"] = """
SELECT event_id, user_id, event_type FROM (
  SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
WHERE nxt IS NULL OR nxt >= ts + INTERVAL 30 MINUTE"""
VERSIONS = """
e AS (SELECT *, epoch_us(ts) AS us, (SELECT min(epoch_us(ts)) FROM events) AS lo, (SELECT max(epoch_us(ts)) FROM events) AS hi FROM events),
s AS (SELECT *, ((us - lo) * 4) // (hi - lo + 1) AS slice FROM e),
v AS (SELECT user_id || '.md' AS path, us, event_type AS text, slice,
             CASE WHEN event_id % 97 = 0 AND slice < 2 THEN slice + 2 ELSE slice END AS arrival
      FROM s WHERE event_type <> 'error' AND user_id % 10 <> 0)"""
# A version older than one that its path had in an earlier slice is dropped.
_SQL["q38b_stream_changed_only"] = f"""WITH {VERSIONS},
a AS (SELECT *, max(us) OVER (PARTITION BY path ORDER BY arrival RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM v)
SELECT path, us AS version_us, text FROM (
  SELECT *, lag(text) OVER (PARTITION BY path ORDER BY arrival, us) AS before FROM a WHERE newest IS NULL OR us >= newest)
WHERE before IS DISTINCT FROM text"""
# Two slices late is behind every watermark.
_SQL["q39b_stream_debounce"] = f"""WITH {VERSIONS}
SELECT path, us AS version_us, text FROM (
  SELECT *, lead(us) OVER (PARTITION BY path ORDER BY us) AS nxt FROM v WHERE arrival = slice)
WHERE nxt IS NULL OR nxt - us >= 30 * 60 * 1000000"""
_SQL["q42_folder_changes"] = """
SELECT doc_id, CASE lang WHEN 'de' THEN 3 WHEN 'fr' THEN 2 ELSE 1 END::BIGINT AS n_versions, 1::BIGINT AS n_created,
       sha256(coalesce(text, '') || CASE lang WHEN 'de' THEN chr(10) || 'edit 2' WHEN 'fr' THEN chr(10) || 'edit 1' ELSE '' END) AS text_hash
FROM documents"""
_SQL["q44_scan_notes"] = "SELECT doc_id, sha256(coalesce(text, '')) AS text_hash FROM documents"

# --- Notes ------------------------------------------------------------------------

_SQL["q40_note_collisions"] = "WITH s AS (" + _SQL["q01_slug_title"] + f"""),
n AS (SELECT source AS alias, slug, doc_id, text, row_number() OVER (PARTITION BY source, slug ORDER BY doc_id DESC) AS r,
        count(*) OVER (PARTITION BY source, slug) - 1 AS collisions FROM documents JOIN s USING (doc_id))
SELECT alias, slug, slug || '.md' AS filename, sha256({trim('text')} || {NL}) AS text_hash, collisions, doc_id
FROM n WHERE r = 1"""
_SQL["q41_full_refresh"] = with_blocks(NOTES, select=f"""
SELECT doc_id, sha256(CASE WHEN regexp_matches(text, '#stale(?:[^a-zA-Z0-9\\-_/]|\\z)')
  THEN {squeeze(f"regexp_replace({without_tags('text', "'stale'")}, '\\n{WS}*\\n{WS}*\\z', {NL})")}
  ELSE text END) AS text_hash FROM N""")


def registry() -> dict[str, str]:
    return dict(_SQL)
