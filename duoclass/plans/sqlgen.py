"""SQL text for the oracles of the scoring queries (DuckDB dialect).

The network's weights are the integer-derived values of ``intmod_model``, written
as integer arithmetic followed by one division so both engines hold identical
doubles.  The relational forward pass is: cells JOIN weights -> SUM per (row, unit)
-> moments per (group, unit) -> normalise -> ReLU -> ... -> softmax.
"""

from __future__ import annotations


def intmod_sql(layer: int, code: int, i: str, j: str) -> str:
    return (f"CAST((31 * {i} + 17 * {j} + {7 * layer + 3 * code}) % 21 - 10 AS DOUBLE) "
            f"/ CAST(100 AS DOUBLE)")


def weights_cte(name: str, layer: int, d: int, h: int, params: str | None = None) -> str:
    if params:
        return f"{name} AS (SELECT i, j, value AS w FROM {params} WHERE layer = {layer} AND name = 'W')"
    return (f"{name} AS (SELECT a.range AS i, b.range AS j, {intmod_sql(layer, 0, 'a.range', 'b.range')} AS w "
            f"FROM range({d}) a, range({h}) b)")


def vector_sql(layer: int, name: str, j: str, params: str | None = None) -> str:
    """Value at ``j`` of a layer's bias, scale or shift."""
    if params:
        return f"(SELECT q.value FROM {params} q WHERE q.layer = {layer} AND q.name = '{name}' AND q.j = {j})"
    v = intmod_sql(layer, ("b", "scale", "beta").index(name) + 1, "0", j)
    return f"(CAST(1 AS DOUBLE) + {v})" if name == "scale" else v


def mlp_ctes(src: str, d: int, hidden: list[int], n_out: int = 2, params: str | None = None, t: str = "") -> str:
    """CTEs ending in ``scored(id, g, label, y0, y1, p0, p1, logp0, logp1, pred)``.

    ``src`` is a CTE name with columns (id, g, label, i, v): one row per input cell.  The
    weights are the integer-derived ones, or those of a relation ``params(layer, name, i, j,
    value)``; ``t`` ends the names of the CTEs.
    """
    parts = []
    sizes = [d] + list(hidden)
    prev = src
    for l in range(1, len(sizes)):
        dl, hl = sizes[l - 1], sizes[l]
        parts.append(weights_cte(f"w{l}{t}", l, dl, hl, params))
        b = vector_sql(l, "b", "w.j", params)
        parts.append(f"z{l}{t} AS (SELECT x.id, x.g, w.j, sum(x.v * w.w) + {b} AS z "
                     f"FROM {prev} x JOIN w{l}{t} w ON x.i = w.i GROUP BY x.id, x.g, w.j)")
        parts.append(f"m{l}{t} AS (SELECT g, j, avg(z) AS mu, var_pop(z) AS var FROM z{l}{t} GROUP BY g, j)")
        sc = vector_sql(l, "scale", "z.j", params)
        be = vector_sql(l, "beta", "z.j", params)
        parts.append(
            f"h{l}{t} AS (SELECT z.id, z.g, z.j AS i, greatest(CAST(0 AS DOUBLE), {sc} * ((z.z - m.mu) / "
            f"sqrt(m.var + CAST(0.001 AS DOUBLE))) + {be}) AS v "
            f"FROM z{l}{t} z JOIN m{l}{t} m ON z.g = m.g AND z.j = m.j)")
        prev = f"h{l}{t}"
    L = len(sizes)
    parts.append(weights_cte(f"wo{t}", L, sizes[-1], n_out, params))
    bo = vector_sql(L, "b", "w.j", params)
    parts.append(f"yl{t} AS (SELECT x.id, x.g, w.j, sum(x.v * w.w) + {bo} AS y "
                 f"FROM {prev} x JOIN wo{t} w ON x.i = w.i GROUP BY x.id, x.g, w.j)")
    parts.append(f"yp{t} AS (SELECT id, g, max(CASE WHEN j = 0 THEN y END) AS y0, "
                 f"max(CASE WHEN j = 1 THEN y END) AS y1 FROM yl{t} GROUP BY id, g)")
    parts.append(f"ye{t} AS (SELECT id, g, y0, y1, greatest(y0, y1) AS m, exp(y0 - greatest(y0, y1)) AS e0, "
                 f"exp(y1 - greatest(y0, y1)) AS e1 FROM yp{t})")
    parts.append(f"labels_src{t} AS (SELECT DISTINCT id, g, label FROM {src})")
    parts.append(f"scored{t} AS (SELECT ye.id, ye.g, l.label, y0, y1, e0 / (e0 + e1) AS p0, e1 / (e0 + e1) AS p1, "
                 "y0 - m - ln(e0 + e1) AS logp0, y1 - m - ln(e0 + e1) AS logp1, "
                 "CASE WHEN y0 >= y1 THEN 0 ELSE 1 END AS pred "
                 f"FROM ye{t} ye JOIN labels_src{t} l ON ye.id = l.id AND ye.g = l.g)")
    return ",\n".join(parts)


EMB_CELLS = """emb_cells AS (
  SELECT vec_id AS id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label,
         CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS i
  FROM embeddings)"""


def emb_src(group: str | None = None) -> str:
    """Source CTE ``src(id, g, label, i, v)`` over all embedding cells, grouped by
    nothing ('all') or by the seeded 0.67 shuffled split."""
    if group is None:
        return EMB_CELLS + ",\nsrc AS (SELECT id, 'all' AS g, label, i, v FROM emb_cells)"
    return EMB_CELLS + """,
ordr AS (SELECT vec_id, row_number() OVER (ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS ix
         FROM embeddings),
nk AS (SELECT CAST(round(CAST(0.67 AS DOUBLE) * count(*)) AS BIGINT) AS k FROM embeddings),
spl AS (SELECT vec_id, CASE WHEN ix < nk.k THEN 'train' ELSE 'test' END AS split FROM ordr, nk),
src AS (SELECT c.id, s.split AS g, c.label, c.i, c.v FROM emb_cells c JOIN spl s ON c.id = s.vec_id)"""


def r6(expr: str) -> str:
    return f"round({expr}, 6) + CAST(0 AS DOUBLE)"


def auc_sql(scored: str, score: str, label: str, group: str | None = None, out: str = "roc_auc") -> str:
    """Mann-Whitney AUC with half credit for ties, from a scored relation."""
    g = f"{group}, " if group else ""
    gsel = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""(SELECT {gsel}sum(pos * (below + neg * CAST(0.5 AS DOUBLE))) / (sum(pos) * sum(neg)) AS {out}
  FROM (SELECT {g}s, pos, neg,
               coalesce(sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                        CAST(0 AS DOUBLE)) AS below
        FROM (SELECT {g}{score} AS s, sum(CAST({label} AS DOUBLE)) AS pos,
                     sum(CAST(1 AS DOUBLE) - CAST({label} AS DOUBLE)) AS neg
              FROM {scored} GROUP BY {g}{score}) gs) t
  {"GROUP BY " + group if group else ""})"""
