"""DuckDB SQL for the queries that SQL can express, written from the contracts."""

from __future__ import annotations

from fitframe.llm.licenses import BASE, LABELS, LEAST_COVER, PART, SLACK, known_grams
from fitframe.llm.url_filter import LEAST_PASSAGE, REFERENCES, RULES

ORACLES: dict[str, str] = {}

ORACLES["op3_nearest"] = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
             AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLES["op4_mixing"] = r"""
WITH w AS (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                  hash(text) AS tie FROM documents),
d AS (SELECT doc_id, source, len(words) AS size, tie,
             -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
             / (CASE WHEN len(words) > 0 THEN greatest(len(list_distinct(words))::DOUBLE / len(words), 0.05::DOUBLE)
                ELSE 1.0::DOUBLE END) AS key FROM w),
s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
n AS (SELECT source, total, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
c AS (SELECT *, total * 2.0::DOUBLE AS cap, total * 2.0::DOUBLE / weight AS ratio FROM n),
l AS (SELECT *, (sum(total) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) /
                (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
      FROM c WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, ratio < level AS capped FROM l),
t AS (SELECT source, total, CASE WHEN capped THEN cap ELSE
        (sum(total) OVER () * 1.5::DOUBLE - coalesce(sum(cap) FILTER (capped) OVER (), 0))
        / (sum(weight) FILTER (NOT capped) OVER ()) * weight END AS target FROM m),
e AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT d.doc_id, d.size, e.total, e.target, e.epochs, round(e.target - e.epochs * e.total)::BIGINT AS extra,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size, d.tie
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, total AS source_size, target,
       (size * epochs + greatest(0, least(size, extra - before)))::BIGINT AS taken FROM r
"""

_rows = ", ".join(
    f"({i}, {t}, '{gram}', '{LABELS[i]}', {len(grams)}, {i < len(BASE)})"
    for i, grams in enumerate(known_grams())
    for t, gram in enumerate(grams)
)
ORACLES["op5_licenses"] = rf"""
WITH known(phrase, place, gram, label, size, is_base) AS (VALUES {_rows}),
d AS (SELECT row_number() OVER () AS row, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT row, spot, w[spot + 1] || ' ' || w[spot + 2] AS gram FROM (SELECT row, w, unnest(range(len(w) - 1)) AS spot FROM d WHERE len(w) > 1)
      UNION ALL SELECT row, spot, array_to_string(w[spot + 1 : spot + 4], ' ')
      FROM (SELECT row, w, unnest(range(len(w) - 3)) AS spot FROM d WHERE len(w) > 3)),
h AS (SELECT row, phrase, spot - place AS diagonal, place // {PART} AS part, bit_or(1::BIGINT << (place % {PART})) AS bits,
             any_value(label) AS label, any_value(size) AS size, bool_or(is_base) AS is_base
      FROM p JOIN known USING (gram) GROUP BY row, phrase, spot - place, place // {PART}),
g AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, phrase ORDER BY diagonal) > {SLACK}
             THEN 1 ELSE 0 END AS cut FROM h),
s AS (SELECT *, sum(cut) OVER (PARTITION BY row, phrase ORDER BY diagonal) AS span,
             CASE WHEN is_base AND bit_count(bits) = size THEN diagonal END AS found FROM g),
y AS (SELECT row, phrase, span, any_value(label) AS label, bool_or(is_base) AS is_base, any_value(size) AS size,
             bit_count(bit_or(bits)) AS covered,
             count(found) AS places, min(found) AS first, max(found) AS last FROM s GROUP BY row, phrase, span, part),
x AS (SELECT row, phrase, span, any_value(label) AS label, bool_or(is_base) AS is_base,
             sum(covered) / any_value(size)::DOUBLE AS share,
             sum(places) AS places, min(first) AS first, max(last) AS last FROM y GROUP BY row, phrase, span),
a AS (SELECT row, sum(places)::BIGINT AS n_base, min(first)::BIGINT AS first_word, max(last)::BIGINT AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label)
               FILTER (places > 0 OR (NOT is_base AND share >= {LEAST_COVER}::DOUBLE)) AS labels,
             max(CASE WHEN places > 0 THEN 1.0::DOUBLE ELSE share END) AS score FROM x GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(coalesce(score, 0.0::DOUBLE), 6) AS score
FROM d LEFT JOIN a USING (row)
"""


def _rule(pick: int) -> str:
    longest_first = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    cases = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[pick]}'"
        for h, p, v in longest_first
    )
    return f"CASE {cases} END"


def _level(name: str, source: str, key: str) -> str:
    """The posterior of one level; its prior is the column ``prior`` of ``source``."""
    return rf"""
{name}_g AS (SELECT {key} AS k, sum(n)::BIGINT AS n, sum(good)::BIGINT AS good, any_value(prior) AS prior FROM {source} GROUP BY 1),
{name}_w AS (SELECT CASE WHEN coalesce(sum(n), 0) = 0 OR sum(n * (good / n::DOUBLE - prior) ** 2) <= sum(prior * (1 - prior)) THEN 1000.0::DOUBLE
    ELSE least(greatest(sum(n * prior * (1 - prior)) / (sum(n * (good / n::DOUBLE - prior) ** 2) - sum(prior * (1 - prior))) - 1, 1.0), 1000.0)
    END AS weight FROM {name}_g WHERE n > 0),
{name}_p AS (SELECT k, n + weight AS whole, (good + weight * prior) / (n + weight) AS share FROM {name}_g, {name}_w),
{name} AS (SELECT h.* REPLACE (p.share AS prior), sqrt(p.share * (1 - p.share) / (p.whole + 1)) AS deviation
           FROM (SELECT host, n, good, prior FROM {source}) h JOIN {name}_p p ON p.k = {key})"""


SUFFIX = "regexp_extract(host, '[^.]*$')"
DOMAIN = r"regexp_extract(host, '([^.]*\.)?[^.]*$')"



def _plain(piece: str) -> str:
    for reference, character in REFERENCES:
        piece = f"""replace({piece}, '{reference}', '{character.replace("'", "''")}')"""
    return piece


ORACLES["op10_url_filter"] = rf"""
WITH rest AS (SELECT row_number() OVER () AS row, page_id, html, regexp_extract(coalesce(url, ''), '(?s)://(.*)', 1) AS r FROM pages),
u AS (SELECT row, page_id, html, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
lab AS (SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good
        FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
dl AS (SELECT DISTINCT d.row, good, trim(line, E' \t\r\n') AS passage
       FROM (SELECT row_number() OVER () AS row, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) d JOIN lab USING (doc_id)
       WHERE length(trim(line, E' \t\r\n')) >= {LEAST_PASSAGE}),
lv AS (SELECT passage, (2 * sum(good) >= count(*))::INT AS good FROM dl GROUP BY passage),
pl AS (SELECT DISTINCT row, host, trim({_plain("piece")}, E' \t\r\n') AS passage
       FROM (SELECT row, host, unnest(regexp_split_to_array(html, '<[^>]*>')) AS piece FROM u)),
pv AS (SELECT row, host, (2 * sum(good) >= count(*))::INT AS good FROM pl JOIN lv USING (passage) GROUP BY row, host),
o AS (SELECT host, count(pv.row) AS n, coalesce(sum(good), 0)::BIGINT AS good FROM u LEFT JOIN pv USING (row, host) GROUP BY host),
base AS (SELECT host, n, good, ((SELECT sum(good) FROM o) + 1.0::DOUBLE) / ((SELECT sum(n) FROM o) + 2.0::DOUBLE) AS prior FROM o),
{_level("su", "base", SUFFIX)},{_level("dm", "su", DOMAIN)},{_level("ho", "dm", "host")}
SELECT page_id, host, path, {_rule(0)} AS rule,
       coalesce({_rule(1)}, CASE WHEN prior + 1.645::DOUBLE * deviation < 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       prior AS share
FROM u JOIN ho USING (host)
"""


def _kmeans_rounds(rounds: int) -> str:
    """One assignment and one set of centroids per round."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""
d{r} AS MATERIALIZED (SELECT v.row, arg_min(struct_pack(cluster := c.cluster, distance := s.distance), (s.distance, c.cluster)) AS best
  FROM v, c{r} c, LATERAL (SELECT list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance) s
  GROUP BY v.row)""")
        if r < rounds:
            parts.append(f"""
m{r} AS MATERIALIZED (SELECT best.cluster AS cluster, place, sum(v.e[place]) AS total, count(*) AS n
  FROM d{r} JOIN v USING (row), range(1, 65) t(place) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.e, c.e) AS e FROM c{r} c LEFT JOIN
  (SELECT cluster, list((total // n - CASE WHEN total % n < 0 THEN 1 ELSE 0 END)::BIGINT ORDER BY place) AS e FROM m{r} GROUP BY cluster) n
  USING (cluster))""")
    return ",".join(parts)


ORACLES["op11_heap_kmeans"] = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id,
    list_transform(embedding, lambda x: floor(1024::DOUBLE * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, e) - 1 AS cluster, e
  FROM v QUALIFY cluster < 8),
{_kmeans_rounds(10)},
s AS (SELECT cluster, sha256(array_to_string(e, ',')) AS sha FROM c10)
SELECT vec_id, best.cluster::INT AS cluster, best.distance AS distance,
  sum(best.distance) OVER (PARTITION BY best.cluster)::BIGINT AS cluster_inertia,
  sum(best.distance) OVER ()::BIGINT AS inertia, sha AS centroid_sha256
FROM d10 JOIN v USING (row) JOIN s ON s.cluster = best.cluster
"""

ORACLES["op12_pivot_search"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256::DOUBLE * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_TO_ENDS = "regexp_split_to_array(lower_text, '[.,;:!?\\x0A-\\x0D]')"
ORACLES["op13_collocations"] = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text FROM documents),
p AS (SELECT lang, unnest({_TO_ENDS}) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
g AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*)::BIGINT AS f
      FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 6) r(m)) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
f AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE f >= 100),
x AS (SELECT lang, array_to_string(w[i : j], ' ') AS phrase, max(f) AS longer
      FROM (SELECT *, unnest(range(i, m + 1)) AS j FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM f)) WHERE j - i + 1 < m GROUP BY ALL),
c AS (SELECT f.* FROM f LEFT JOIN x USING (lang, phrase) WHERE m >= 2 AND (longer IS NULL OR 100 * longer < 100 * f)),
k AS (SELECT c.lang, c.phrase, c.f AS a, a.f AS l, b.f AS r, n.n,
             ((1000::HUGEINT * c.f * n.n) // (a.f::HUGEINT * b.f))::BIGINT AS score, k
      FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
      JOIN f a ON a.lang = c.lang AND a.phrase = array_to_string(c.w[1 : k], ' ')
      JOIN f b ON b.lang = c.lang AND b.phrase = array_to_string(c.w[k + 1 :], ' ')
      JOIN n ON n.lang = c.lang),
s AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM s)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""
