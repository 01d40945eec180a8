"""The derived views as DuckDB common table expressions, for the comparison queries."""

from __future__ import annotations

_BANDS = ",\n".join(
    f"""CASE WHEN n_{d} > 0 THEN q_{d} / (n_{d} * 50) END AS nir_{d},
        CASE WHEN n_{d} > 0 THEN d_{d} / (n_{d} * 10) END AS swir_{d},
        CASE WHEN n_{d} > 0 THEN t_{d} / (n_{d} * 20) END AS red_{d},
        CASE WHEN n_{d} > 0 THEN (q_{d} % 97) / 300::DOUBLE END AS green_{d},
        CASE WHEN n_{d} > 0 THEN (d_{d} % 31) / 200::DOUBLE END AS blue_{d},
        coalesce((q_{d} + y * x) % 12, 0)::INT AS scl_{d}, coalesce(q_{d}, 0)::BIGINT AS dn_{d}"""
    for d in ("pre", "post")
)
_SUMS = ", ".join(
    f"sum(CASE WHEN {w} THEN {c} END)::BIGINT AS {c}_{d}" for d, w in (("pre", "pre"), ("post", "NOT pre")) for c in "qdt"
)

#: name -> (views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "dims": ((), "SELECT floor(sqrt(count(*) // 24))::BIGINT AS s FROM lineitem"),
    "px": (
        ("dims",),
        f"""SELECT y, x, {_BANDS}, ((y // 5 + x // 7) % 6 - 1)::INT AS fuel FROM (
            SELECT y, x, {_SUMS}, count(*) FILTER (pre) AS n_pre, count(*) FILTER (NOT pre) AS n_post FROM (
                SELECT l_partkey % s AS y, l_orderkey % s AS x, year(l_shipdate) < 1998 AS pre, l_quantity::BIGINT AS q,
                       round(l_discount * 100)::BIGINT AS d, round(l_tax * 100)::BIGINT AS t FROM lineitem, dims)
            GROUP BY y, x)""",
    ),
    "delta": (
        ("px",),
        """SELECT *, npre - npost AS dnbr, (npre - npost) / sqrt(greatest(abs(npre), 0.001::DOUBLE)) AS rdnbr,
               scl_pre NOT IN (0, 1, 3, 8, 9, 10) AND scl_post NOT IN (0, 1, 3, 8, 9, 10) AS ok FROM (
            SELECT *, CASE WHEN abs(nir_pre + swir_pre) >= 1e-6 THEN (nir_pre - swir_pre) / (nir_pre + swir_pre) END AS npre,
                      CASE WHEN abs(nir_post + swir_post) >= 1e-6 THEN (nir_post - swir_post) / (nir_post + swir_post) END AS npost
            FROM px)""",
    ),
    "classed": (
        ("delta",),
        """SELECT *, CASE WHEN dnbr IS NULL THEN -1 ELSE (dnbr >= -0.25)::INT + (dnbr >= -0.10)::INT + (dnbr >= 0.10)::INT
               + (dnbr >= 0.27)::INT + (dnbr >= 0.44)::INT + (dnbr >= 0.66)::INT END AS cls FROM delta""",
    ),
    "names": (
        (),
        """SELECT * FROM (VALUES (0, 'high regrowth'), (1, 'low regrowth'), (2, 'unburned'), (3, 'low severity'),
            (4, 'moderate-low severity'), (5, 'moderate-high severity'), (6, 'high severity')) n(code, label)""",
    ),
    "dense": (
        (),
        """SELECT vec_id AS y, (i - 1)::BIGINT AS x, embedding[i]::DOUBLE AS v, label::INT AS label
            FROM (SELECT vec_id, embedding, label, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
    ),
    "hourly": (
        (),
        """SELECT ts, 12 + (s % 2300) / 100::DOUBLE AS temp, 20 + (s % 7000) / 100::DOUBLE AS rh, (s % 3000) / 100::DOUBLE AS wind,
               (s % 360)::DOUBLE AS dir, (s % 4100) / 100::DOUBLE AS gust,
               CASE WHEN n % 7 = 0 THEN (s % 500) / 100::DOUBLE ELSE 0 END AS precip, (s % 2200)::DOUBLE AS blh
            FROM (SELECT date_trunc('hour', ts) AS ts, abs(sum(round(value * 100)::BIGINT)::BIGINT) AS s, count(*) AS n
                  FROM events GROUP BY 1)""",
    ),
    "problems": (
        ("dims",),
        """SELECT b.*, n_name AS area_name, r_name AS cluster_name FROM (
            SELECT c_custkey AS id, c_name AS name, nullif(c_nationkey, 24) AS area_id, nullif(c_mktsegment, 'MACHINERY') AS colour,
                   (c_custkey % 70)::INT AS grade_no, (c_custkey * 7919) % (10 * s) / 10::DOUBLE AS col_f,
                   (c_custkey * 104729) % (10 * s) / 10::DOUBLE AS row_f, 2.4::DOUBLE + (c_custkey % 400) / 1000::DOUBLE AS lon,
                   48.2::DOUBLE + (c_custkey % 300) / 1000::DOUBLE AS lat FROM customer, dims) b
            LEFT JOIN nation ON n_nationkey = area_id LEFT JOIN region ON r_regionkey = n_regionkey""",
    ),
    "catalogue": (
        (),
        """SELECT 'S2_' || o_orderkey AS id, o_orderdate AS datetime, floor(o_totalprice)::BIGINT % 100 AS cloud,
               CASE WHEN o_orderkey % 11 <> 0 THEN ['02.14', '03.99', '04.00', '05.10', 'abc'][o_orderkey % 5 + 1] END AS baseline,
               CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS applied,
               2.0::DOUBLE + (o_orderkey % 100) / 100::DOUBLE AS west, 48.0::DOUBLE + (o_orderkey % 80) / 100::DOUBLE AS south
            FROM orders""",
    ),
    "orbits": (
        (),
        """SELECT 'COGT/OFFL/L2/' || strftime(ts, '%Y/%m/%d') || '/S5P_' || event_id || '_' || strftime(ts, '%Y%m%dT%H%M%S') || '_'
               || strftime(ts + INTERVAL 100 MINUTE, '%Y%m%dT%H%M%S') || '_'
               || CASE WHEN user_id % 3 = 0 THEN 'PRODUCT_aerosol_index' ELSE 'PRODUCT_carbonmonoxide' END || '_4326.tif' AS key,
               ((floor(value)::BIGINT % 100 + 100) % 100)::DOUBLE AS coverage FROM events""",
    ),
    "places": (
        (),
        """SELECT CASE s_suppkey % 9 WHEN 0 THEN 'Carrefour de ' WHEN 1 THEN 'Croix de ' ELSE '' END || s_name AS name,
               ['city', 'town', 'village', 'hamlet', 'peak', 'locality', 'other'][s_suppkey % 7 + 1] AS place,
               CASE WHEN s_suppkey % 5 <> 0 THEN ['1 234', '1234 (2019)', '', '499', '500', '10000', 'none'][s_suppkey % 7 + 1] END AS population,
               48.2::DOUBLE + (s_suppkey * 37 % 300) / 1000::DOUBLE AS lat, 2.4::DOUBLE + (s_suppkey * 53 % 400) / 1000::DOUBLE AS lon
            FROM supplier
            UNION ALL SELECT array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' '),
               'village', (n_nationkey * 700)::VARCHAR, 48.25::DOUBLE + n_nationkey / 100::DOUBLE, 2.45::DOUBLE + n_nationkey / 100::DOUBLE
            FROM nation""",
    ),
    "polygons": (
        (),
        """SELECT (k * 2 + part)::INT AS seq, (k % 5)::INT AS code, CASE part
                WHEN 0 THEN [{'x': a, 'y': b}, {'x': a + 6, 'y': b}, {'x': a + 6, 'y': b + 4}, {'x': a, 'y': b + 4}]
                ELSE [{'x': a + 3, 'y': b + 2}, {'x': a + 11, 'y': b + 3}, {'x': a + 5, 'y': b + 9}] END AS ring
            FROM (SELECT n_nationkey AS k, (n_nationkey * 5 % 43)::DOUBLE + 0.25::DOUBLE AS a,
                         (n_nationkey * 11 % 41)::DOUBLE + 0.75::DOUBLE AS b, unnest([0, 1]) AS part FROM nation)""",
    ),
    "swaths": (
        ("dense",),
        """SELECT (y // 40 % 10)::INT AS day, y // 400 * 40 + y % 40 AS y, x, CASE WHEN (y * 7 + x * 3) % 11 <> 0 THEN v END AS v, label FROM dense""",
    ),
    # features with their window statistics
    "windows": (
        ("delta", "problems", "dims"),
        """SELECT id, count(v) AS n, median(v) AS med, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75, min(v) AS lo, max(v) AS hi
            FROM (SELECT id, CASE WHEN ok OR NOT bool_or(ok) OVER (PARTITION BY id) THEN dnbr END AS v
                  FROM (SELECT id, round_even(col_f, 0)::BIGINT AS ci, round_even(row_f, 0)::BIGINT AS ri FROM problems) f, dims
                  JOIN delta ON true WHERE ci < s AND ri < s AND abs(y - ri) <= 2 AND abs(x - ci) <= 2)
            GROUP BY id HAVING count(v) > 0""",
    ),
    "sampled": (
        ("windows", "problems", "dims"),
        """SELECT p.*, round_even(col_f, 0) < s AND round_even(row_f, 0) < s AS in_aoi, round_even(med, 4) AS dnbr_median,
               round_even(p25, 4) AS dnbr_p25, round_even(p75, 4) AS dnbr_p75, round_even(p75 - p25, 4) AS dnbr_iqr,
               round_even(lo, 4) AS dnbr_min, round_even(hi, 4) AS dnbr_max, n AS n_px,
               CASE WHEN med IS NOT NULL THEN (med >= -0.25)::INT + (med >= -0.10)::INT + (med >= 0.10)::INT + (med >= 0.27)::INT + (med >= 0.44)::INT + (med >= 0.66)::INT END AS cls,
               (p25 >= -0.25)::INT + (p25 >= -0.10)::INT + (p25 >= 0.10)::INT + (p25 >= 0.27)::INT + (p25 >= 0.44)::INT + (p25 >= 0.66)::INT
               <> (p75 >= -0.25)::INT + (p75 >= -0.10)::INT + (p75 >= 0.10)::INT + (p75 >= 0.27)::INT + (p75 >= 0.44)::INT + (p75 >= 0.66)::INT AS edge
            FROM problems p, dims LEFT JOIN windows w ON w.id = p.id""",
    ),
}


def with_views(sql: str, names: tuple[str, ...]) -> str:
    """``sql`` with the common table expressions that it needs, in order."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    body = sql.strip()
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
    if body.upper().startswith("WITH"):
        return f"WITH {recursive}{ctes},\n{body[len('WITH RECURSIVE') if recursive else 4 :]}"
    return f"WITH {ctes}\n{body}"
