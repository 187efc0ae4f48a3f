"""DuckDB SQL of partial least squares."""
from __future__ import annotations

EMBEDDED = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"


def pls_sql(components: int) -> str:
    """Partial least squares by deflation, a component after another, over the long matrix."""
    out = f"{EMBEDDED}, m AS (SELECT i, avg(v) AS m FROM e GROUP BY 1), x0 AS (SELECT vec_id, e.i, v - m AS v FROM e JOIN m ON e.i = m.i), y0 AS (SELECT vec_id, label - avg(label) OVER () AS y FROM embeddings)"
    for k in range(components):
        out += f""", w{k} AS (SELECT i, sum(v * y) AS w FROM x{k} JOIN y{k} USING (vec_id) GROUP BY 1), t{k} AS (SELECT vec_id, sum(v * w) / (SELECT sqrt(sum(w * w)) FROM w{k}) AS t FROM x{k} JOIN w{k} USING (i) GROUP BY 1),
        s{k} AS (SELECT sum(t * t) AS tt, sum(t * y) / sum(t * t) AS q FROM t{k} JOIN y{k} USING (vec_id)), p{k} AS (SELECT i, sum(v * t) / (SELECT tt FROM s{k}) AS p FROM x{k} JOIN t{k} USING (vec_id) GROUP BY 1),
        x{k + 1} AS (SELECT vec_id, i, v - t * p AS v FROM x{k} JOIN t{k} USING (vec_id) JOIN p{k} USING (i)), y{k + 1} AS (SELECT vec_id, y - (SELECT q FROM s{k}) * t AS y FROM y{k} JOIN t{k} USING (vec_id))"""
    return f"WITH {out} SELECT vec_id, round(label - y, 6) AS predicted FROM y{components} JOIN embeddings USING (vec_id)"
