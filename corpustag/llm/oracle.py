"""DuckDB twins of the numbered queries that SQL can express."""

from __future__ import annotations

import string

from corpustag.llm import line_dedup, mixing, quality_rules, resampling, sharding, va_file

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def words(text: str) -> str:
    return WORDS.format(text=text)


def line_dedup_sql() -> str:
    return f"""
    WITH pages AS (SELECT row_number() OVER () AS page, * FROM documents),
    lines AS (SELECT DISTINCT page, source, unnest(string_split(text, chr(10))) AS line FROM pages),
    totals AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
    seen AS (SELECT source, line, count(*) AS n FROM lines WHERE trim(line) <> '' GROUP BY source, line),
    bad AS (SELECT s.source, list(line) AS lines FROM seen s JOIN totals t ON s.source IS NOT DISTINCT FROM t.source
            WHERE n >= {line_dedup.MIN_PAGES} AND n > {line_dedup.RATIO}::DOUBLE * total GROUP BY s.source),
    kept AS (SELECT doc_id, p.source, string_split(text, chr(10)) AS before,
                    list_filter(string_split(text, chr(10)), lambda l: NOT coalesce(list_contains(b.lines, l), false)) AS after
             FROM pages p LEFT JOIN bad b ON p.source IS NOT DISTINCT FROM b.source)
    SELECT doc_id, source, len(before) AS n_lines, len(before) - len(after) AS n_dropped,
           coalesce(array_to_string(after, chr(10)), '') AS text FROM kept"""


def quality_rules_sql() -> str:
    q = quality_rules
    removed, chain = "text", []
    for i, pattern in enumerate(q.CLASSES):
        removed = f"regexp_replace({removed}, '{pattern}', '', 'g')"
        chain.append(removed)
    lengths = ["length(text)"] + [f"length({c})" for c in chain] + ["0"]
    classes = ", ".join(f"{a} - {b}" for a, b in zip(lengths, lengths[1:]))
    n = len(q.CLASSES) + 1
    part = lambda a, b: f"(CASE WHEN {a} > 0 THEN {a} * log2(2.0 * {a} / ({a} + {b})) ELSE 0.0 END)"
    jsd = lambda p, r: f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({p}, {r}), lambda z: {part('z[1]', 'z[2]')} + {part('z[2]', 'z[1]')})) / 2))"
    return f"""
    WITH d AS MATERIALIZED (
        SELECT row_number() OVER () AS r, doc_id, lang, text, {words('text')} AS w, [{classes}]::DOUBLE[] AS c
        FROM (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents)),
    windows AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
                FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
    twice AS (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM (
                  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows) WHERE n > 1),
    repeats AS (SELECT r, count(DISTINCT place) AS n FROM twice GROUP BY r),
    inked AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
    dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM inked WHERE regexp_matches(line, '{q.INK}') GROUP BY r),
    sums AS (SELECT lang, [{', '.join(f'sum(c[{i + 1}])' for i in range(n))}] AS c FROM d GROUP BY lang),
    ref AS (SELECT lang, list_transform(c, lambda x: CASE WHEN list_sum(c) > 0 THEN x / list_sum(c) ELSE 0.0 END) AS ref_c FROM sums),
    counts AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM d) GROUP BY lang, word),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k, sum(n) OVER (PARTITION BY lang) AS total FROM counts),
    top AS (SELECT lang, list(word ORDER BY k) AS words, list(n / total ORDER BY k) AS shares FROM ranked WHERE k <= {q.COMMON_WORDS} GROUP BY lang),
    m AS (SELECT d.r, d.doc_id, len(w) AS n_words, length(regexp_replace(text, '{q.SPACE}', '', 'g')) AS word_chars,
                 length(text) - length(translate(text, '{q.SYMBOLS}', '')) AS n_symbols,
                 coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
                 list_transform(c, lambda x: CASE WHEN list_sum(c) > 0 THEN x / list_sum(c) ELSE 0.0 END) AS c, ref_c, shares,
                 list_transform(top.words, lambda t: len(list_filter(w, lambda x: x = t)) / greatest(len(w), 1)) AS found,
                 list_append(shares, 1.0 - list_sum(shares)) AS ref_w, list_append(list_transform(shares, lambda s: 0.0), 1.0) AS no_w
          FROM d LEFT JOIN dups USING (r) LEFT JOIN repeats USING (r)
          LEFT JOIN ref ON d.lang IS NOT DISTINCT FROM ref.lang LEFT JOIN top ON d.lang IS NOT DISTINCT FROM top.lang),
    j AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                 coalesce({jsd('c', 'ref_c')}, 0.0) AS class_distance,
                 coalesce({jsd('list_append(found, 1.0 - list_sum(found))', 'ref_w')}, 0.0) AS word_distance, {jsd('no_w', 'ref_w')} AS no_words
          FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT (class_distance > {q.MAX_CLASS_DISTANCE} OR coalesce(word_distance > least(
               {q.LAST_WORD_SHARE} * no_words, sqrt(pow({q.MAX_WORD_SHARE} * no_words, 2) + {q.CHANCE!r}::DOUBLE / n_words)), false)) AS kept FROM j"""


def crc32_sql(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, eight bit steps a byte, over its hexadecimal form."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    bits = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: " + step + ")"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: {bits}), 4294967295)"


def sharding_sql(n_shards: int = 8, seed: int = 11) -> str:
    """Rounds and walks one by one as columns; a second walk is enough for all but vanishing cases at test size."""
    keys = sharding.round_keys(seed)
    p = sharding.PRIME

    def scrambled(column: str, ks: list[int]) -> str:
        value = column
        for k in ks:
            value = f"((({value} + {k}) % {p}) * (({value} + {k}) % {p}) + {k})"
        return value

    ctes, source, number = [], "numbered", "row_no"
    for walk in range(3):
        last = f"w{walk}"
        ctes.append(f"{last}_0 AS (SELECT *, {number} // b AS l, {number} % b AS r FROM {source})")
        for i, ks in enumerate(keys):
            l, r = ("(l + {}) % a".format(scrambled("r", ks)), "r") if i % 2 == 0 else ("l", "(r + {}) % b".format(scrambled("l", ks)))
            ctes.append(f"{last}_{i + 1} AS MATERIALIZED (SELECT * EXCLUDE (l, r), {l} AS l, {r} AS r FROM {last}_{i})")
        value = "l * b + r" if walk == 0 else "CASE WHEN p < total THEN p ELSE l * b + r END"
        drop = "l, r" if walk == 0 else "l, r, p"
        ctes.append(f"{last} AS (SELECT * EXCLUDE ({drop}), {value} AS p FROM {last}_{len(keys)})")
        source, number = last, "p"
    chain = ", ".join(ctes)
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    sized AS MATERIALIZED (SELECT doc_id, octet_length(encode(text))::BIGINT + 1 AS size, {crc32_sql('text')} AS text_crc32 FROM docs),
    total AS (SELECT count(*) AS total, floor(sqrt(count(*) - 1))::BIGINT + 1 AS a FROM sized),
    numbered AS (SELECT sized.*, total, a, (total + a - 1) // a AS b,
                        row_number() OVER (ORDER BY doc_id NULLS LAST, size, text_crc32) - 1 AS row_no FROM sized, total),
    {chain}
    SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {n_shards})::INTEGER AS shard, p // {n_shards} AS slot,
           NULL::INTEGER AS grown_shard FROM {source}"""


def mixing_sql(share: float = 1.5, cap: float = 2.0, seed: int = 7) -> str:
    weights = list(mixing.WEIGHTS)
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, len({words("coalesce(text, '')")}) AS size FROM documents),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, md5(coalesce(doc_id::VARCHAR, '')), r) - 1 AS k FROM docs),
    sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
    weighed AS (SELECT *, {cap}::DOUBLE * source_size AS cap,
                       ({weights})[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)}] AS weight FROM sources),
    level AS (SELECT *, ({share}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (
                       ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                       / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
              FROM weighed),
    goal AS (SELECT source, source_size, least(cap, coalesce(weight * (
                        SELECT arg_min(level, cap / weight) FROM level WHERE level * weight <= cap), cap)) AS target,
                    ('0x' || substr(md5('{seed}/' || coalesce('s:' || source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
             FROM level),
    rated AS (SELECT doc_id, size, source_size, target, k, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
              FROM ranked JOIN goal ON ranked.source IS NOT DISTINCT FROM goal.source)
    SELECT doc_id, size, source_size, target,
           (least(floor(rate * (k + 1) + u) - floor(rate * k + u), {int(cap)}) * size)::BIGINT AS taken FROM rated"""


def warc_sql() -> str:
    return """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 1000) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM g"""


def clustering_sql() -> str:
    """Rounds one by one; every vector is compared with every centroid."""
    v = va_file
    squared = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    ctes = []
    for i in range(v.ROUNDS + 1):
        ctes.append(f"a{i} AS MATERIALIZED (SELECT r, k, far FROM (SELECT r, k, {squared} AS far FROM kept, c{i}) "
                    "QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, k) = 1)")
        if i < v.ROUNDS:
            ctes.append(f"""
    c{i + 1} AS MATERIALIZED (
        SELECT c{i}.k, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
            SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY d) AS c FROM (
                SELECT k, d, sum(v)::BIGINT AS s, count(*) AS n FROM (
                    SELECT k, unnest(x) AS v, unnest(generate_series(1, {v.DIMENSIONS})) AS d FROM a{i} JOIN kept USING (r)) GROUP BY k, d)
            GROUP BY k) m USING (k))""")
    return f"""
    WITH raw AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS e FROM embeddings),
    kept AS MATERIALIZED (SELECT r, vec_id, list_transform(e, lambda y: floor({v.SCALE} * y)::BIGINT) AS x FROM raw
             WHERE len(e) = {v.DIMENSIONS} AND len(list_filter(e, lambda y: isfinite(y))) = {v.DIMENSIONS}),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY lot) - 1 AS k, x AS c FROM (
               SELECT sha256('3:' || vec_id) AS lot, x FROM kept ORDER BY lot LIMIT {v.CENTROIDS})),
    {', '.join(ctes)}
    SELECT vec_id, a.k::INTEGER AS cluster, far::BIGINT AS distance, (sum(far) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
           (sum(far) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{v.ROUNDS} a JOIN kept USING (r) JOIN c{v.ROUNDS} c ON a.k = c.k"""


def resampling_sql(seed: int = 7) -> str:
    q = resampling
    lower = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    words_of = rf"regexp_extract_all({lower}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
    features = "list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))"
    counts = lambda name, of: f"{name} AS (SELECT bucket, sum(n) AS n FROM {of} JOIN hashed USING (feature) GROUP BY bucket)"
    return f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words_of} AS w FROM documents),
    f AS MATERIALIZED (SELECT r, feature, count(*) AS n FROM (SELECT r, unnest({features}) AS feature FROM d) GROUP BY r, feature),
    g AS MATERIALIZED (SELECT feature, count(*) AS n FROM (
             SELECT unnest({features}) AS feature FROM (SELECT {words_of} AS w FROM benchmark)) GROUP BY feature),
    hashed AS MATERIALIZED (SELECT feature, {crc32_sql('feature')} % {q.BUCKETS} AS bucket FROM (
                SELECT feature FROM f UNION SELECT feature FROM g)),
    {counts('source', 'f')}, {counts('target', 'g')},
    sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM source)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM target)::DOUBLE AS t_all),
    gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + {q.BUCKETS})
                                            / ((s.n + 1)::DOUBLE * (t_all + {q.BUCKETS}))))::BIGINT AS gain
             FROM source s LEFT JOIN target t USING (bucket), sums),
    weighed AS (SELECT r, sum(f.n)::BIGINT AS n, sum(f.n * gain)::BIGINT AS s FROM f JOIN hashed USING (feature) JOIN gain USING (bucket) GROUP BY r),
    noisy AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce((s - ((s % n) + n) % n) // n, 0) AS weight,
                     floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
              FROM d LEFT JOIN weighed USING (r)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {q.MIN_WORDS} ORDER BY weight + noise DESC, doc_id) AS k,
                      count(*) OVER (PARTITION BY n_words >= {q.MIN_WORDS}) AS n FROM noisy)
    SELECT doc_id, n_features, weight, weight + noise AS score,
           CASE WHEN n_words >= {q.MIN_WORDS} AND k <= {q.PERCENT} * n // 100 THEN k END AS rank FROM ranked"""


def registry() -> dict[str, str]:
    return {
        "op4_line_dedup": line_dedup_sql(),
        "op5_quality_rules": quality_rules_sql(),
        "op7_warc": warc_sql(),
        "op8_sharding": sharding_sql(),
        "op10_mixing": mixing_sql(),
        "op11_centroid_clustering": clustering_sql(),
        "op12_importance_resampling": resampling_sql(),
    }
