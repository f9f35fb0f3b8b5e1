"""Queries of the graph, parsing and matrix operators over the fixture views, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafmill.functions import vec
from grafmill.operators import graph, matrix
from grafmill.plans.fixtures import oracle, view
from grafmill.sources import text

QUERIES, SQL = {}, {}
ALPHA, CHANNELS, SOURCE = 0.9, 5, 0


def query(body: str, ctes: str = "", recursive: bool = False):
    """Register a query under its function's name with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = oracle(body, ctes, recursive)
        return f

    return add


# ------------------------------------------------------------------------------------------------ ranking
NODES = "n as (select src id from edges union select dst from edges), cn as (select cast(count(*) as double) cnt from n)"


def transition(edges: str, name: str = "e", src: str = "src", dst: str = "dst", w: str = "cast(1 as double)") -> str:
    return f"{name} as (select {src} src, {dst} dst, {w} / k p from {edges} join (select {src} ks, count(*) k from {edges} group by {src}) on ks = {src})"


def walk(steps: int, back: str) -> str:
    """r0 -> r1 -> ...: back is the restart of node n.id."""
    return ", ".join(f"r{t} as (select n.id, {back} * (1 - {ALPHA}e0) + {ALPHA}e0 * coalesce(x, 0) v from n cross join cn left join (select dst, sum(v * p) x from e join r{t - 1} on id = src group by dst) on dst = n.id)" for t in range(1, steps + 1))


EVEN = "r0 as (select id, 1 / cnt v from n cross join cn)"


def ranks(df: DataFrame) -> DataFrame:
    return df.select("id", vec.rounded(F.col("v")[0], 10).alias("rank"))


@query("select id, round(v, 10) + 0 as rank from r3", f"{NODES}, {transition('edges')}, {EVEN}, {walk(3, '(1 / cnt)')}")
def pagerank(spark, sf_dir):
    return ranks(graph.pagerank(view(spark, sf_dir, "edges"), 3, ALPHA))


@query("select id, round(v, 10) + 0 as rank from r3", f"{NODES}, {transition('edges_w', w='w')}, {EVEN}, {walk(3, '(1 / cnt)')}")
def pagerank_weighted_adj(spark, sf_dir):
    lists = graph.adjacency(view(spark, sf_dir, "edges_w"))
    return ranks(graph.pagerank(graph.from_adjacency(lists), 3, ALPHA))


BACK = "coalesce((select 1 / cast(count(*) as double) from node_map) * (select 1 from node_map m where m.id = n.id), 0)"


@query("select id, round(v, 10) + 0 as rank from r3", f"{NODES}, {transition('edges')}, {EVEN}, {walk(3, BACK)}")
def pagerank_personalized(spark, sf_dir):
    return ranks(graph.pagerank(view(spark, sf_dir, "edges"), 3, ALPHA, restart=graph.uniform_importance(view(spark, sf_dir, "node_map"))))


MANY = (
    f"r0 as (select n.id, q.k, coalesce(v, 0) v from n cross join (select unnest(range({CHANNELS})) k) q left join channels c on c.id = n.id and c.k = q.k), "
    + ", ".join(f"r{t} as (select r.id, r.k, (1 / cnt) * (1 - {ALPHA}e0) + {ALPHA}e0 * coalesce(x, 0) v from r0 r cross join cn left join (select dst, k, sum(v * p) x from e join r{t - 1} on id = src group by dst, k) s on s.dst = r.id and s.k = r.k)" for t in (1, 2, 3))
)


@query("select id, k, round(v, 8) + 0 as v from r3", f"{NODES}, {transition('edges')}, {MANY}")
def pagerank_multichannel(spark, sf_dir):
    start = graph.dense_importance(view(spark, sf_dir, "channels"), CHANNELS)
    out = graph.pagerank(view(spark, sf_dir, "edges"), 3, ALPHA, CHANNELS, start=start)
    return out.select("id", F.posexplode("v").alias("k", "v")).select("id", F.col("k").cast("long").alias("k"), vec.rounded(F.col("v")).alias("v"))


@query("select count(*) as n from edges where src not in (select id from node_map)")
def missing_vectors(spark, sf_dir):
    return graph.missing(view(spark, sf_dir, "edges"), view(spark, sf_dir, "node_map"))


HITS = ", ".join(
    f"a{t} as (select n.id, coalesce(x, 0) v from n left join (select dst, {ALPHA}e0 * sum(v * p) x from e join h{t - 1} on id = src group by dst) on dst = n.id), "
    f"h{t} as (select n.id, coalesce(x, 0) v from n left join (select dst, {ALPHA}e0 * sum(v * p) x from b join a{t} on id = src group by dst) on dst = n.id)"
    for t in (1, 2)
)


@query("select id, round(a2.v, 10) + 0 as authority, round(h2.v, 10) + 0 as hub from a2 join h2 using (id)", f"{NODES}, {transition('edges_w', w='w')}, {transition('edges_w', 'b', 'dst', 'src', 'w')}, h0 as (select id, 1 / cnt v from n cross join cn), {HITS}")
def hits(spark, sf_dir):
    out = graph.hits(view(spark, sf_dir, "edges_w"), 2, ALPHA)
    return out.select("id", vec.rounded(F.col("authority"), 10).alias("authority"), vec.rounded(F.col("hub"), 10).alias("hub"))


# ------------------------------------------------------------------------------------------------ search
RELAX = f"d0 as (select cast({SOURCE} as bigint) id, cast(0 as double) dist), " + ", ".join(f"d{t} as (select id, min(dist) dist from (select id, dist from d{t - 1} union all select dst, dist + w from edges_w join d{t - 1} on src = id) group by id)" for t in range(1, 5))


@query("select id, dist from d4", RELAX)
def sssp(spark, sf_dir):
    return graph.shortest_paths(view(spark, sf_dir, "edges_w"), SOURCE, 4)


@query("select id, cast(min(h) as bigint) as hops from walked group by id", f"walked(id, h) as (select cast({SOURCE} as bigint), 0 union select dst, h + 1 from walked join edges on src = id where h < 12)", recursive=True)
def reachable_hops(spark, sf_dir):
    return graph.hops(view(spark, sf_dir, "edges"), SOURCE, 12)


REACH = f"s0 as (select cast({SOURCE} as bigint) id), " + ", ".join(f"s{t} as (select id from s{t - 1} union select src from edges where dst in (select id from s{t - 1}))" for t in (1, 2))


@query("select id from s2", REACH)
def bfs_expand_reverse(spark, sf_dir):
    seeds = spark.range(1).select(F.lit(SOURCE).cast("long").alias("id"))
    return graph.expand_reverse(view(spark, sf_dir, "edges"), seeds, 2)


BAND = "s0 as (select id, 1 n from node_map), " + ", ".join(f"s{t} as (select id, count(*) n from (select dst id from edges join s{t - 1} on src = id union all select id from s{t - 1}) group by id having count(*) between 5 and 60)" for t in (1, 2))


@query("select id, cast(n as bigint) as n from s2", BAND)
def bfs_band(spark, sf_dir):
    return graph.expand_band(view(spark, sf_dir, "edges"), view(spark, sf_dir, "node_map"), 2, 5, 60)


# ------------------------------------------------------------------------------------------------ diameter
FOLD = "xor(id, id >> 32) & 4294967295"
MASKS = f"m0 as (select id, cast(1 as bigint) << least(cast(bit_count(({FOLD} & -({FOLD})) - 1) as integer), 31) mask from n), " + ", ".join(f"m{t} as (select id, bit_or(mask) mask from (select id, mask from m{t - 1} union all select src, mask from edges join m{t - 1} on id = dst) group by id)" for t in range(1, 5))
SIZES = "sizes as (" + " union all ".join(f"select cast({t} as bigint) h, sum(pow(cast(2 as double), cast(bit_count((~mask & -(~mask)) - 1) as double)) / 0.77351e0) n from m{t}" for t in range(5)) + ")"


@query("select id, mask from m0", f"{NODES}, {MASKS}")
def hadi_bitmask(spark, sf_dir):
    return graph.sketch(graph.nodes(view(spark, sf_dir, "edges")))


@query("select id, mask from m1", f"{NODES}, {MASKS}")
def hadi_step(spark, sf_dir):
    edges = view(spark, sf_dir, "edges")
    return graph.sketch_step(edges, graph.sketch(graph.nodes(edges)))


@query("select h, round(n, 6) + 0 as n from sizes", f"{NODES}, {MASKS}, {SIZES}")
def hadi_neighbourhood(spark, sf_dir):
    return graph.neighbourhood(view(spark, sf_dir, "edges"), 4).select("h", vec.rounded(F.col("n"), 6).alias("n"))


@query("select h as diameter, round(n, 6) + 0 as n from (select h, n, lead(n) over (order by h) more from sizes) where n * 1.001e0 > more or more is null order by h limit 1", f"{NODES}, {MASKS}, {SIZES}")
def hadi_diameter(spark, sf_dir):
    return graph.effective_diameter(view(spark, sf_dir, "edges"), 4).select("diameter", vec.rounded(F.col("n"), 6).alias("n"))


# ------------------------------------------------------------------------------------------------ statistics, building blocks
@query("select count(*) as n from edges")
def edge_count(spark, sf_dir):
    return view(spark, sf_dir, "edges").agg(F.count("*").alias("n"))


@query("select n as degree, count(*) as nodes from (select src, count(*) n from edges group by src) group by n")
def degree_dist_out(spark, sf_dir):
    return graph.degree_distribution(view(spark, sf_dir, "edges"), "src")


@query("select n as degree, count(*) as nodes from (select dst, count(*) n from edges group by dst) group by n")
def degree_dist_in(spark, sf_dir):
    return graph.degree_distribution(view(spark, sf_dir, "edges"), "dst")


@query("select src as id, string_agg(concat(dst, ':', cast(w as bigint)), ',' order by dst) as nbrs from edges_w group by src")
def adjacency_list(spark, sf_dir):
    lists = graph.adjacency(view(spark, sf_dir, "edges_w"))
    return lists.select("id", F.array_join(F.transform("nbrs", lambda x: F.concat_ws(":", x["id"].cast("string"), x["w"].cast("long").cast("string"))), ",").alias("nbrs"))


@query("select src as id, count(*) as n from edges group by src")
def link_counts(spark, sf_dir):
    return graph.link_counts(view(spark, sf_dir, "edges"))


@query("select id, round(1 / cnt, 10) + 0 as v0, round(1 / cnt, 10) + 0 as v1 from n cross join cn", NODES)
def importance_uniform(spark, sf_dir):
    out = graph.uniform_importance(graph.nodes(view(spark, sf_dir, "edges")), 2)
    return out.select("id", *(vec.rounded(F.col("v")[k], 10).alias(f"v{k}") for k in (0, 1)))


@query("select id, " + ", ".join(f"round(coalesce(sum(case when k = {k} then v end), 0), 8) + 0 as v{k}" for k in range(CHANNELS)) + " from channels group by id")
def importance_dense(spark, sf_dir):
    out = graph.dense_importance(view(spark, sf_dir, "channels"), CHANNELS)
    return out.select("id", *(vec.rounded(F.col("v")[k]).alias(f"v{k}") for k in range(CHANNELS)))


@query("select src, dst from edges where src in (select id from node_map) and dst in (select id from node_map)")
def induced_subgraph(spark, sf_dir):
    return graph.induced(view(spark, sf_dir, "edges"), view(spark, sf_dir, "node_map"))


@query("select id from n", NODES)
def node_dictionary(spark, sf_dir):
    return graph.nodes(view(spark, sf_dir, "edges"))


@query("select src, dst, 'forth' as tag from edges union all select dst, src, 'back' from edges")
def edge_reverse_union(spark, sf_dir):
    edges = view(spark, sf_dir, "edges")
    return text.tagged_union(forth=edges, back=graph.reverse(edges))


# ------------------------------------------------------------------------------------------------ parsing
@query("select cast(split_part(value, ';', 1) as bigint) as src, cast(split_part(value, ';', 2) as bigint) as dst from im_lines where split_part(split_part(value, ';', 3), ',', 1) = '1' and regexp_matches(value, '^[0-9][^;]*;[0-9]')")
def parse_im(spark, sf_dir):
    return text.parse_im(view(spark, sf_dir, "im_lines"))


@query("select cast(split_part(value, chr(9), 1) as bigint) as src, cast(split_part(value, chr(9), 2) as bigint) as dst from microblog_lines")
def parse_microblog(spark, sf_dir):
    return text.parse_microblog(view(spark, sf_dir, "microblog_lines"))


@query("select id, k, f from (select cast(p[2] as bigint) id, unnest(range(len(p) - 2)) k, unnest(p[3:]) f from (select string_split(value, ',') p from userinfo_lines)) where f <> ''")
def parse_userinfo(spark, sf_dir):
    return text.parse_userinfo(view(spark, sf_dir, "userinfo_lines"))


@query("select concat(left(k, length(k) - 2), substr(value, length(k) + 1)) as value, k as key from (select value, split_part(value, ',', 1) k from key_lines)")
def key_trim(spark, sf_dir):
    return text.trim_keys(view(spark, sf_dir, "key_lines"))


@query("select id, dense_rank() over (order by id) - 1 as ix from (select distinct i as id from ratings_cp)")
def id_mapping(spark, sf_dir):
    return matrix.dense_ids(view(spark, sf_dir, "ratings_cp"), "i")


# ------------------------------------------------------------------------------------------------ files
@query("select u, i, r from ratings_cp")
def io_ratings_round_trip(spark, sf_dir):
    path = text.scratch(spark, "ratings")
    text.write_text(view(spark, sf_dir, "ratings_cp").select("u", "i", "r"), path, ",")
    return text.read_ratings(spark, path)


@query("select src, dst from edges")
def io_edges_round_trip(spark, sf_dir):
    path = text.scratch(spark, "edges")
    text.write_text(view(spark, sf_dir, "edges"), path)
    return text.read_edges(spark, path)


@query("select src, dst, w from edges_w")
def io_binary_round_trip(spark, sf_dir):
    path = text.scratch(spark, "edges-binary")
    text.write_binary(view(spark, sf_dir, "edges_w"), path)
    return text.read_binary(spark, path)


@query("select src, dst from edges union all select dst, src from edges")
def io_append(spark, sf_dir):
    """Saved once, then appended to."""
    path, edges = text.scratch(spark, "edges-appended"), view(spark, sf_dir, "edges")
    text.write_text(edges, path)
    text.write_text(graph.reverse(edges).select("src", "dst"), path, mode="append")
    return text.read_edges(spark, path)


@query("select value from key_lines")
def io_lines(spark, sf_dir):
    path = text.scratch(spark, "lines")
    view(spark, sf_dir, "key_lines").write.text(path)
    return text.read_lines(spark, path)


@query("select value, cast(0 as bigint) as left_behind from key_lines")
def io_merge_move(spark, sf_dir):
    """Parts merged into one file, the source deleted, the result moved."""
    parts, merged, moved = (text.scratch(spark, n) for n in ("parts", "merged", "moved"))
    view(spark, sf_dir, "key_lines").write.text(parts)
    text.merge_copy(spark, parts, merged, delete_source=True)
    text.move(spark, merged, moved)
    left = sum(text.exists(spark, p) for p in (parts, merged))
    return text.read_lines(spark, moved).select("value", F.lit(left).cast("long").alias("left_behind"))


@query("select id, string_agg(cast(cast(v as bigint) as varchar), ',' order by k) as line from (select id, k, cast(floor(v) as bigint) v from channels) group by id")
def io_array_csv(spark, sf_dir):
    """Vectors as lines of numbers."""
    rows = view(spark, sf_dir, "channels").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", F.floor("v").cast("long").alias("v")))).alias("rows"))
    return rows.select("id", text.joined_vector("rows.v").alias("line"))


@query(f"select cast({SOURCE} as bigint) as id, cast(0 as double) as dist")
def io_seed_row(spark, sf_dir):
    return text.seed_row(spark, SOURCE)


@query("select vec_id as id, cast(k as bigint) as k, cast(x as double) as x from (select vec_id, unnest(range(len(embedding))) k, unnest(embedding) x from embeddings)")
def io_matrix_round_trip(spark, sf_dir):
    path = text.scratch(spark, "matrix")
    text.write_matrix(view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x")), path)
    return text.read_matrix(spark, path).select("id", F.posexplode("x").alias("k", "x")).select("id", F.col("k").cast("long").alias("k"), "x")


# ------------------------------------------------------------------------------------------------ matrices
def embeddings(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


LONG = "a as (select vec_id i, unnest(range(len(embedding))) k, cast(unnest(embedding) as double) p from embeddings)"


@query("select i, j, round(sum(p * q), 8) + 0 as c from a join b using (k) group by i, j", f"{LONG}, b as (select k, j, cast((k * 7919 + j * 104729 + 7 * 1299709) % 1000 as double) / 1000 / 3 q from (select unnest(range(64)) k), (select unnest(range(3)) j))")
def matmul_dense(spark, sf_dir):
    b = spark.range(64).select("id", vec.init("id", 7, 3).alias("x"))
    return matrix.dense_dense(embeddings(spark, sf_dir), b).select("i", "j", vec.rounded(F.col("c")).alias("c"))


@query("select cast(x.k as bigint) as i, cast(y.k as bigint) as j, round(sum(x.p * y.p), 6) + 0 as c from a x join a y on x.i = y.i group by 1, 2", LONG)
def matmul_transposed(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return matrix.transpose_times(e, e, 64).select("i", "j", vec.rounded(F.col("c"), 6).alias("c"))


@query("select i as id, j, round(sum(r * cast((u * 7919 + j * 104729 + 3 * 1299709) % 1000 as double) / 1000 / 2), 6) + 0 as x from ratings_ui, (select unnest(range(2)) j) group by i, j")
def matmul_sparse_dense(spark, sf_dir):
    ratings = view(spark, sf_dir, "ratings_ui")
    b = ratings.select(F.col("u").alias("id")).distinct().select("id", vec.init("id", 3, 2).alias("x"))
    out = matrix.sparse_dense(ratings.select(F.col("u").alias("k"), F.col("i").alias("id"), F.col("r").alias("val")), b, 2)
    return out.select("id", F.posexplode("x").alias("j", "x")).select("id", F.col("j").cast("long").alias("j"), vec.rounded(F.col("x"), 6).alias("x"))
