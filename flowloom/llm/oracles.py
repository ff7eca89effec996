"""SQL for the operators that SQL can express."""

from __future__ import annotations

_LOWERED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWERED + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format('text')} AS w FROM benchmark),
bw AS (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bw),
starts AS (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
occ AS (SELECT DISTINCT rid, s, k, item FROM (SELECT rid, s, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM starts) JOIN win USING (k, g)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS p FROM occ) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""

FILL_MIDDLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('7:', CAST(doc_id AS VARCHAR))) AS d FROM documents),
l AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines, CAST(concat('0x', substr(d, 1, 8)) AS BIGINT) AS h1,
  CAST(concat('0x', substr(d, 9, 8)) AS BIGINT) AS h2, CAST(concat('0x', substr(d, 17, 8)) AS BIGINT) AS h3,
  CAST(concat('0x', substr(d, 25, 8)) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a,
  greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b FROM l),
p AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
    WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form, array_to_string(lines[1:a], '') AS prefix,
  array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle)
    ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def vector_codes(dims: int = 64, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Rounds of assignment and integer means, one pair of tables a round."""
    width = dims // parts
    xs = [f"x{i}" for i in range(width)]
    distance = " + ".join(f"(v.{x} - b.{x}) * (v.{x} - b.{x})" for x in xs)
    mean = ", ".join(f"CAST(coalesce((s.{x} - (s.{x} % s.n + s.n) % s.n) // s.n, b.{x}) AS BIGINT) AS {x}" for x in xs)
    ctes = [
        "kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL "
        "AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "v AS MATERIALIZED (" + " UNION ALL ".join(
            f"SELECT rid, {p} AS p, " + ", ".join(
                f"CAST(floor(CAST(embedding[{p * width + i + 1}] AS DOUBLE) * {scale}) AS BIGINT) AS {x}" for i, x in enumerate(xs))
            + " FROM kept" for p in range(parts)) + ")",
        f"b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, {', '.join(xs)} FROM v WHERE rid <= {entries})"]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT v.rid, v.p, min(({distance}) * {entries} + b.e) AS best FROM v JOIN b{r} b ON v.p = b.p "
                    "GROUP BY v.rid, v.p)")
        if r < rounds:
            ctes.append(f"s{r} AS MATERIALIZED (SELECT v.p, a.best % {entries} AS e, count(*) AS n, "
                        + ", ".join(f"CAST(sum({x}) AS BIGINT) AS {x}" for x in xs)
                        + f" FROM v JOIN a{r} a ON v.rid = a.rid AND v.p = a.p GROUP BY v.p, a.best % {entries})")
            ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, {mean} FROM b{r} b LEFT JOIN s{r} s ON b.p = s.p AND b.e = s.e)")
    joined = ", ".join(f"CAST({x} AS VARCHAR)" for x in xs)
    return f"""WITH {', '.join(ctes)},
coded AS (SELECT rid, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error
  FROM a{rounds} GROUP BY rid),
books AS (SELECT sha256(string_agg(concat_ws(',', {joined}), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rid), books"""


ORACLES = {"op11_decontamination": DECONTAMINATION, "op12_fill_middle": FILL_MIDDLE, "op13_vector_codes": vector_codes()}
