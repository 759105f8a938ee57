"""The vector codes of cover_tree_codes as DuckDB SQL: the same rounds, each point compared with every entry."""

from __future__ import annotations


def vector_codes_sql(table: str = "embeddings", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """One CTE for each assignment and each codebook. Sums of doubles are exact, as all values are integers of moderate size."""
    ctes = {
        "kept": f"SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid FROM {table} WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0",
        "points": f"SELECT rid, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) r(part)",
        "book0": f"SELECT part, rid - 1 AS entry, x AS c FROM points WHERE rid <= {entries}",
    }
    for i in range(rounds + 1):
        away = "list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c)"
        ctes[f"near{i}"] = f"SELECT rid, part, min((d, entry)) AS m FROM (SELECT rid, part, entry, {away} AS d FROM points JOIN book{i} USING (part)) GROUP BY rid, part"
        if i < rounds:
            mean = f"SELECT part, entry, list(f ORDER BY i) AS c FROM (SELECT part, entry, i, floor(sum(x[i]) / count(*)) AS f FROM (SELECT n.part, n.m[2] AS entry, x, unnest(range(1, len(x) + 1)) AS i FROM near{i} n JOIN points p ON p.rid = n.rid AND p.part = n.part) GROUP BY part, entry, i) GROUP BY part, entry"
            ctes[f"book{i + 1}"] = f"SELECT b.part, b.entry, coalesce(u.c, b.c) AS c FROM book{i} b LEFT JOIN ({mean}) u ON u.part = b.part AND u.entry = b.entry"
    ctes["coded"] = f"SELECT rid, string_agg(lower(lpad(to_hex(m[2]), 2, '0')), '' ORDER BY part) AS code, sum(m[1])::BIGINT AS error FROM near{rounds} GROUP BY rid"
    ctes["digest"] = f"SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}"
    named = ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in ctes.items())
    return f"WITH {named}\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (rid), digest"
