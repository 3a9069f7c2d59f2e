"""Queries over the test tables, one for each operator, and their SQL where SQL can express it."""

from __future__ import annotations

from . import embeddings, html_text, mixing, ngram_join, packing, pii, quality_rules, site_quality, token_files, toxicity

QUERIES = {
    "op9_mixing": mixing.query,
    "op7_packing": packing.query,
    "op1_toxicity": toxicity.query,
    "op2_embeddings": embeddings.query,
    "op4_site_quality": site_quality.query,
    "op5_html_text": html_text.query,
    "op10_pii": pii.query,
    "op8_ngram_join": ngram_join.query,
    "op6_quality_rules": quality_rules.query,
    "op3_token_files": token_files.query,
}
_REACH = "r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), low AS (SELECT x, min(y) AS y FROM r GROUP BY 1)"



def _mixing() -> str:
    """The mix by windows over whole sources: sizes and keys, targets by filling up, for each of three passes in key order the
    first key that does not fit, and one document at a bound."""
    parts = [r"""d AS (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        k AS (SELECT doc_id, source, size, -ln((CAST('0x' || substr(md5(concat_ws('|', '17', CAST(doc_id AS VARCHAR), source, text)), 1, 13) AS BIGINT)::DOUBLE + 0.5::DOUBLE) * pow(2::DOUBLE, -52))
            / greatest(0.1::DOUBLE, coalesce(greatest(0::DOUBLE, 2 * (length(translate(text, '#*$%&|<>', ''))::DOUBLE / greatest(1, length(text))) - 1) * least(1::DOUBLE, size::DOUBLE / 20), 0.1::DOUBLE)) AS key FROM d),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY 1),
        w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, 3 * source_size::DOUBLE AS cap FROM s),
        m AS (SELECT *, cap / weight AS ratio, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        t AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM m WHERE level <= ratio ORDER BY ratio, level LIMIT 1)) AS target FROM m),
        p AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / greatest(1, source_size) + 1e-9::DOUBLE)) ELSE 0 END AS epochs FROM t),
        p0 AS (SELECT *, greatest(0::DOUBLE, target - epochs * source_size) AS left0 FROM p)"""]
    for n in (1, 2, 3):
        behind = f"AND k.key > p.next{n - 1} AND k.size <= p.left{n - 1}" if n > 1 else ""
        parts.append(f"""g{n} AS (SELECT k.source, k.key, sum(k.size) AS s, any_value(p.left{n - 1}) AS room FROM k JOIN p{n - 1} p ON k.source IS NOT DISTINCT FROM p.source WHERE k.size > 0 {behind} GROUP BY 1, 2),
        e{n} AS (SELECT *, sum(s) OVER (PARTITION BY source ORDER BY key) AS e FROM g{n}),
        f{n} AS (SELECT source, min(key) FILTER (WHERE e > room) AS next, arg_min(s, key) FILTER (WHERE e > room) AS size, coalesce(min(e - s) FILTER (WHERE e > room), sum(s)) AS used FROM e{n} GROUP BY 1),
        p{n} AS (SELECT p.*, p.left{n - 1} - coalesce(f.used, 0) AS left{n}, coalesce(f.next, 'inf'::DOUBLE) AS next{n}, coalesce(f.size, 0) AS size{n} FROM p{n - 1} p LEFT JOIN f{n} f ON f.source IS NOT DISTINCT FROM p.source)""")
    ends = ", ".join(f"{{'o': abs(size{n} - left3), 'k': next{n}, 's': size{n}}}" for n in (1, 2, 3))
    parts.append(f"z AS (SELECT *, list_sort(list_filter([{ends}], lambda x: x.s > 0 AND x.s < 2 * left3))[1].k AS nearest FROM p3)")
    chosen = "k.key < z.next1 OR k.key > z.next1 AND k.size <= z.left1 AND k.key < z.next2 OR k.key > z.next2 AND k.size <= z.left2 AND k.key < z.next3 OR coalesce(k.key = z.nearest, FALSE)"
    return f"""WITH {", ".join(parts)} SELECT doc_id, size, source_size, target, CAST((epochs + CASE WHEN ({chosen}) AND left0 > 0 THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
        FROM k JOIN z ON k.source IS NOT DISTINCT FROM z.source"""


def _quality() -> str:
    """Base counts by lists of words and lines, histograms, medians of their shares by language, and distances."""
    r = quality_rules
    blank, letters = r"\x20\x09-\x0D", "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    kinds = ["aeiouy", "b-df-hj-np-tv-xz", "A-Z", "0-9", blank, r""".,;:!?''"()\-""", "#*$%&|<>"]
    count = lambda k: f"length(regexp_replace(x, '[^{k}]', '', 'g'))"
    ascii_ = "length(regexp_replace(x, '[^\\x00-\\x7F]', '', 'g'))"
    names = ", ".join("'" + w.decode() + "'" for w in r.WORDS)
    part = "(CASE WHEN z[{a}] > 0 THEN z[{a}] * log2(z[{a}] / ((z[{a}] + z[{b}]) / 2)) ELSE 0::DOUBLE END)"
    far = lambda p, q: f"CASE WHEN {q} IS NOT NULL THEN sqrt(greatest(0::DOUBLE, list_sum(list_transform(list_zip({p}, {q}), lambda z: ({part.format(a=1, b=2)} + {part.format(a=2, b=1)}) / 2)))) END"
    return rf"""WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS x FROM documents),
        w AS (SELECT doc_id, lang, x, regexp_extract_all(x, '[^{blank}]+') AS ws, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^{blank}]')) AS ls FROM t),
        g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
        e AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), (SELECT range AS j FROM range(0, 5)) WHERE c > 1 GROUP BY 1),
        c AS (SELECT doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, {count(kinds[6])}::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
            length(x) AS n_chars, [{", ".join(map(count, kinds))}] AS k, length(x) - {ascii_} AS high FROM w),
        h AS (SELECT doc_id, histogram(lw) AS m FROM (SELECT doc_id, translate(unnest(ws), {letters}) AS lw FROM w) GROUP BY 1),
        v AS (SELECT c.*, list_transform([{names}], lambda y: coalesce(h.m[y], 0)) AS b FROM c LEFT JOIN h USING (doc_id)),
        p AS (SELECT *, list_transform(k || [n_chars - high - list_sum(k), high], lambda y: CASE WHEN n_chars > 0 THEN y::DOUBLE / n_chars ELSE 0 END) AS pk,
            list_transform([n_words - list_sum(b)] || b, lambda y: CASE WHEN n_words > 0 THEN y::DOUBLE / n_words ELSE 0 END) AS pb FROM v),
        u AS (SELECT lang, 'k' AS kind, unnest(range(1, len(pk) + 1)) AS i, unnest(pk) AS y FROM p WHERE n_words >= {r.MIN_WORDS} UNION ALL SELECT lang, 'b', unnest(range(1, len(pb) + 1)), unnest(pb) FROM p WHERE n_words >= {r.MIN_WORDS}),
        m AS (SELECT lang, kind, i, quantile_disc(floor(y * {r.GRID}), 0.5) / {r.GRID} AS y FROM u GROUP BY 1, 2, 3),
        f AS (SELECT lang, kind, list(y ORDER BY i) AS q, sum(y ORDER BY i) AS s FROM m GROUP BY 1, 2),
        o AS (SELECT lang, kind, list_transform(q, lambda y: CASE WHEN s > 0 THEN y / s ELSE 0 END) AS q FROM f),
        d AS (SELECT p.*, CASE WHEN n_chars >= {6 * r.MIN_WORDS} OR n_words >= {r.MIN_WORDS} THEN {far("pk", "a.q")} END AS dk, CASE WHEN n_words >= {r.MIN_WORDS} THEN {far("pb", "z2.q")} END AS db, coalesce(e.n, 0)::BIGINT AS n_repeat_words
            FROM p LEFT JOIN o a ON a.kind = 'k' AND a.lang IS NOT DISTINCT FROM p.lang LEFT JOIN o z2 ON z2.kind = 'b' AND z2.lang IS NOT DISTINCT FROM p.lang LEFT JOIN e ON e.doc_id = p.doc_id)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
            NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT coalesce(dk > {r.MAX_CLASS_DISTANCE}::DOUBLE + {r.NOISE}::DOUBLE / sqrt(greatest(1, n_words)) OR db > {r.MAX_WORD_DISTANCE}::DOUBLE, FALSE) AS kept,
            round(dk, 6) AS class_distance, round(db, 6) AS word_distance FROM d"""


ORACLE_SQL: dict[str, str] = {
    "op9_mixing": _mixing(),
    "op6_quality_rules": _quality(),
    "op2_embeddings": f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_dot_product(a.e, b.e) >= 0.95 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
        {_REACH}, n AS (SELECT x, count(*) AS n FROM e GROUP BY 1)
        SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low.y, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low.y, vec_id)) AS kept
        FROM v LEFT JOIN n ON n.x = vec_id LEFT JOIN low ON low.x = vec_id""",
    "op8_ngram_join": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)), {_REACH}
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low.y, d.doc_id)) AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.x = d.doc_id""",
}
