"""Views that turn the driver's tables into graphs, ratings and tensors. One SQL text serves Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

KIND = "case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end"

VIEWS = {
    "tr": "select user_id src, lead(user_id) over (partition by cast(ts as date) order by ts, event_id) dst from events",
    "edges": "select distinct src, dst from tr where dst is not null and src <> dst",
    "edges_w": "select src, dst, cast(count(*) as double) w from tr where dst is not null and src <> dst group by src, dst",
    "node_map": "select user_id id from events group by user_id having 5 * sum(case when event_type = 'error' then 1 else 0 end) >= count(*)",
    "ratings_ui": f"select user_id u, cast(hour(ts) as bigint) * 5 + cast({KIND} as bigint) i, max(value) r from events group by 1, 2",
    "ratings_s": "select u, i, greatest(r, cast(0.01 as double)) / cast(1000 as double) r from ratings_ui",
    "ratings_cp": "select o_custkey u, l_partkey i, max(l_quantity) r from lineitem join orders on l_orderkey = o_orderkey group by 1, 2",
    "tensor": f"select user_id p, cast({KIND} as bigint) q, cast(hour(ts) as bigint) o, greatest(max(value), cast(0.01 as double)) / cast(1000 as double) r from events group by 1, 2, 3",
    "cmf_ms": "select user_id u, cast(day(ts) - 1 as bigint) s, greatest(max(value), cast(0.01 as double)) / cast(1000 as double) r from events group by 1, 2",
    "cmf_mv": f"select cast(hour(ts) as bigint) * 5 + cast({KIND} as bigint) i, cast(day(ts) - 1 as bigint) s, greatest(max(value), cast(0.01 as double)) / cast(1000 as double) r from events group by 1, 2",
    "channels": f"select user_id id, cast({KIND} as bigint) k, max(value) v from events group by 1, 2",
    "prefs": "select x.u u, x.i a, y.i b from ratings_s x join ratings_s y on x.u = y.u where x.r > y.r",
    "im_lines": "select concat(user_id, ';', event_id, ';', case when event_type = 'click' then 1 else 0 end, ',0') as value from events",
    "microblog_lines": "select concat(src, chr(9), dst) as value from edges",
    "userinfo_lines": "select concat('x,', c_custkey, ',', c_nationkey, ',,', c_mktsegment, ',', length(c_name)) as value from customer",
    "key_lines": "select concat(o_orderkey, '_1,', o_custkey) as value from orders",
}

TABLES = ("events", "lineitem", "orders", "customer", "embeddings", "part", "supplier", "nation", "region")


def needed(sql: str) -> list[str]:
    """Views that a statement needs, those they need first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in out and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    chain = needed(sql)
    for t in TABLES:
        if re.search(rf"\b{t}\b", " ".join([sql, *(VIEWS[v] for v in chain)])):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    clauses = ", ".join(f"{v} as ({VIEWS[v]})" for v in chain)
    return spark.sql(f"with {clauses} {sql}" if clauses else sql)


def oracle(body: str, ctes: str = "", recursive: bool = False) -> str:
    """A statement for DuckDB with the views it needs in front."""
    chain = [f"{v} as ({VIEWS[v]})" for v in needed(body + ctes)]
    if ctes:
        chain.append(ctes)
    return f"with {'recursive ' * recursive}{', '.join(chain)} {body}" if chain else body
