"""Vectors, masks, grids and strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from manyvec.functions import grids as G
from manyvec.functions import texts as T
from manyvec.functions import vectors as V
from manyvec.operators import scoring as S
from manyvec.operators.blocks import rounded_column
from manyvec.plans.fixtures import bags, d_tokens, query, sql, table, vectors


def six(v):
    """A vector to six digits, in text (so that -0.0 and 0.0 agree)."""
    return F.transform(v, lambda x: F.round(x, 6) + 0.0)


SIX = "list_transform({0}, lambda x: round(x, 6) + 0.0::DOUBLE)"


@query(sql(f"SELECT vec_id, {SIX.format('list_transform(v, lambda y: 3 * y / sqrt(list_dot_product(v, v) * 9))')} AS v FROM e"))
def l2_normalized_vectors(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", six(V.l2_normalize(V.scale(F.col("v"), 3.0))).alias("v"))


def weights(rows: int, dim: int = 64) -> list[list[float]]:
    return [[((i * 31 + j * 17) % 13 - 6) / 10 for j in range(dim)] for i in range(rows)]


@query(sql("SELECT vec_id, [" + ", ".join(f"round(list_dot_product(v, [{', '.join(map(str, w))}]::DOUBLE[]), 6)" for w in weights(4)) + "] AS v FROM e"))
def projected_vectors(spark, sf_dir):
    out = V.project(F.col("v"), weights(4))
    return vectors(spark, sf_dir).select("vec_id", F.transform(out, lambda x: rounded_column(x, 6)).alias("v"))


@query(sql(f"SELECT vec_id, {SIX.format('list_transform(v[1:16], lambda y: y / sqrt(list_dot_product(v[1:16], v[1:16])))')} AS v FROM e"))
def matryoshka_vectors(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", six(V.matryoshka(F.col("v"), 16, allowed=(16, 32, 64))).alias("v"))


@query(sql("SELECT pid, tok, label FROM dt WHERE label % 2 = 0"))
def masked_tokens(spark, sf_dir):
    """Tokens whose mask is set, here even labels."""
    return d_tokens(spark, sf_dir).where("label % 2 = 0").select("pid", "tok", "label")


def pooled(how):
    def run(spark, sf_dir):
        return bags(d_tokens(spark, sf_dir), "pid").select("pid", six(V.pool(F.col("toks"), how)).alias("v"))

    return run


UNIT = SIX.format("list_transform(v, lambda y: y / sqrt(list_dot_product(v, v)))")


@query(sql(f"SELECT pid, {UNIT} AS v FROM dt WHERE tok = 0"))
def pooled_first(spark, sf_dir):
    return pooled("cls")(spark, sf_dir)


@query(sql(f"SELECT pid, {UNIT} AS v FROM (SELECT *, max(tok) OVER (PARTITION BY pid) AS last FROM dt) WHERE tok = last"))
def pooled_last(spark, sf_dir):
    return pooled("last")(spark, sf_dir)


@query(sql(f"SELECT pid, {UNIT} AS v FROM (SELECT pid, list(x ORDER BY i) AS v FROM (SELECT pid, i, avg(v[i]) AS x FROM dt, range(1, 65) t(i) GROUP BY ALL) GROUP BY pid)"))
def pooled_mean(spark, sf_dir):
    return pooled("mean")(spark, sf_dir)


PADDED = "padded AS (SELECT pid, list(v ORDER BY tok) AS toks FROM (SELECT pid, tok, v FROM dt UNION ALL SELECT pid, tok + 100, list_transform(v, lambda x: 0.0::DOUBLE) FROM dt WHERE tok < 2) GROUP BY pid)"


def padded(spark, sf_dir, side):
    toks = F.col("toks")
    return bags(d_tokens(spark, sf_dir), "pid").select("pid", V.repad(toks, F.size(toks) + 2, F.lit(64), side).alias("toks"))


@query(sql("SELECT pid, count(*) AS n, round(sum(list_sum(v)), 5) AS total FROM dt GROUP BY pid"))
def unpadded_right(spark, sf_dir):
    kept = padded(spark, sf_dir, "right").select("pid", V.unpad(F.col("toks"), "right").alias("toks"))
    return summed(kept)


@query(sql("SELECT pid, count(*) AS n, round(sum(list_sum(v)), 5) AS total FROM dt GROUP BY pid"))
def unpadded_left(spark, sf_dir):
    return summed(padded(spark, sf_dir, "left").select("pid", V.unpad(F.col("toks"), "left").alias("toks")))


@query(sql("SELECT pid, count(*) + 2 AS n, round(sum(list_sum(v)), 5) AS total FROM dt GROUP BY pid"))
def repadded(spark, sf_dir):
    return summed(padded(spark, sf_dir, "right"))


def summed(bag):
    flat = F.aggregate(F.flatten("toks"), F.lit(0.0), lambda s, x: s + x)
    return bag.select("pid", F.size("toks").cast("long").alias("n"), F.round(flat, 5).alias("total"))


@query("SELECT s.doc_id, i AS pos FROM (SELECT doc_id, n_chars % 7 + 1 AS n FROM documents) s, range(0, 8) t(i) WHERE i < n")
def length_masks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "n_chars % 7 + 1 AS n")
    return docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("pos"))


TOKENS = "k AS (SELECT pid AS page, tok AS pos, label % 3 <> 0 AS image FROM dt)"


def page_tokens(spark, sf_dir):
    return d_tokens(spark, sf_dir).selectExpr("pid AS page", "tok AS pos", "label % 3 <> 0 AS image", "v")


@query(sql("SELECT page, pos, image AND (n <= 2 OR back > 2) AS local FROM (SELECT *, count(*) FILTER (image) OVER (PARTITION BY page) AS n, row_number() OVER (PARTITION BY page, image ORDER BY pos DESC) AS back FROM k)", TOKENS))
def local_image_masks(spark, sf_dir):
    return G.local_image_mask(page_tokens(spark, sf_dir), "page", F.col("image"), 2).select("page", "pos", "local")


@query("""SELECT vec_id, t % 12 AS x, t // 12 AS y, ((t // 16) % 3) * 4 + (t % 16) % 4 AS tile_x, ((t // 16) // 3) * 4 + (t % 16) // 4 AS tile_y FROM (SELECT vec_id, vec_id % 96 AS t FROM embeddings)""")
def token_places(spark, sf_dir):
    """Every vector as a token of a page of 96, placed row by row and in tiles of 4 x 4."""
    t = F.col("vec_id") % 96
    (x, y), (tx, ty) = G.row_major(t, 12), G.tile_order(t, 4, 3)
    return table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"), y.alias("y"), tx.alias("tile_x"), ty.alias("tile_y"))


SHAPES = "d AS (SELECT doc_id, 40 + n_chars % 900 AS h, 60 + (n_chars * 7) % 1500 AS w FROM documents)"


def shapes(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "40 + n_chars % 900 AS h", "60 + (n_chars * 7) % 1500 AS w")


EDGES = """CASE WHEN w >= h THEN greatest(trunc({0} / (w / h))::BIGINT + trunc({0} / (w / h))::BIGINT % 2, 1) ELSE {0} END AS hn,
CASE WHEN w >= h THEN {0} ELSE greatest(trunc({0} * (w / h))::BIGINT + trunc({0} * (w / h))::BIGINT % 2, 1) END AS wn"""


@query(f"WITH {SHAPES} SELECT doc_id, hn::BIGINT AS height, wn::BIGINT AS width, ceil(wn / 364)::BIGINT AS x, ceil(hn / 364)::BIGINT AS y, ceil(wn / 512)::BIGINT * 8 AS tiles_x, ceil(hn / 512)::BIGINT * 8 AS tiles_y FROM (SELECT doc_id, {EDGES.format(1456)} FROM d)")
def resized_grids(spark, sf_dir):
    h, w = F.col("h"), F.col("w")
    (rh, rw), (x, y), (tx, ty) = G.resized(h, w, 1456), G.patches_ceil(h, w, 364, 1456), G.patches_split(h, w, 1456)
    return shapes(spark, sf_dir).select("doc_id", rh.alias("height"), rw.alias("width"), *[c.cast("long").alias(n) for c, n in ((x, "x"), (y, "y"), (tx, "tiles_x"), (ty, "tiles_y"))])


SMART = """WITH {0}, r AS (SELECT doc_id, h, w, greatest(round_even(h / 28, 0), 1) * 28 AS hb, greatest(round_even(w / 28, 0), 1) * 28 AS wb FROM d),
f AS (SELECT doc_id, CASE WHEN hb * wb > 602112 THEN greatest(28, floor(w / sqrt(h * w / 602112.0::DOUBLE) / 28) * 28) WHEN hb * wb < 3136 THEN ceil(w * sqrt(3136.0::DOUBLE / (h * w)) / 28) * 28 ELSE wb END AS wn,
  CASE WHEN hb * wb > 602112 THEN greatest(28, floor(h / sqrt(h * w / 602112.0::DOUBLE) / 28) * 28) WHEN hb * wb < 3136 THEN ceil(h * sqrt(3136.0::DOUBLE / (h * w)) / 28) * 28 ELSE hb END AS hn FROM r)
SELECT doc_id, trunc(wn / 28)::BIGINT AS x, trunc(hn / 28)::BIGINT AS y FROM f"""


@query(SMART.format(SHAPES))
def smart_resize_grids(spark, sf_dir):
    x, y = G.patches_smart(F.col("w"), F.col("h"))
    return shapes(spark, sf_dir).select("doc_id", x.alias("x"), y.alias("y"))


@query("SELECT doc_id, n * n AS tokens, n AS side, (448 // 14)::BIGINT AS fixed_x, n * 28 * 28 AS max_pixels FROM (SELECT doc_id, 1 + n_chars % 39 AS n FROM documents)")
def fixed_grids(spark, sf_dir):
    """Sides of square grids, of as many tokens as each document's length gives."""
    n = 1 + F.col("n_chars") % 39
    return table(spark, sf_dir, "documents").select("doc_id", (n * n).alias("tokens"), G.square_side(n * n).alias("side"), F.lit(G.patches_fixed(448, 14)[0]).cast("long").alias("fixed_x"), G.max_pixels(n).alias("max_pixels"))


@query("""WITH k AS (SELECT doc_id, i AS pos, i % 2 = 0 AS image FROM documents, range(0, 8) t(i) WHERE i < 4 * (1 + doc_id % 2)),
b AS (SELECT doc_id, count(*) FILTER (image) // 2 AS blocks FROM k GROUP BY doc_id), o AS (SELECT doc_id, coalesce(sum(blocks) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT doc_id, pos, (CASE WHEN image THEN (pos // 2) // 2 + before ELSE -1 END)::BIGINT AS block, (CASE WHEN image THEN (pos // 2) % 2 ELSE -1 END)::BIGINT AS local FROM k JOIN o USING (doc_id)""")
def scattered_image_blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.expr("sequence(0L, 4 * (1 + doc_id % 2) - 1)")).alias("pos"))
    return G.scatter_blocks(docs, "doc_id", F.col("pos") % 2 == 0, 2).select("doc_id", "pos", *[F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ("block", "local")])


@query(sql("""SELECT pid, (y // 2) * 2 + x // 2 AS tok, list(round(p, 6) + 0.0::DOUBLE ORDER BY (y % 2) * 2 + x % 2, i) AS v FROM (
SELECT vec_id // 16 AS pid, vec_id % 4 AS x, (vec_id % 16) // 4 AS y, i, v[i] AS p FROM e, range(1, 5) t(i)) GROUP BY ALL"""))
def pixel_shuffled(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.expr("vec_id div 16").alias("pid"), F.expr("vec_id % 16").alias("tok"), F.slice("v", 1, 4).alias("v"))
    return G.pixel_shuffle(rows, "pid", 4, 2).select("pid", "tok", six(F.col("v")).alias("v"))


@query("SELECT item_id, 'Query: ' || text || repeat('<|endoftext|>', 10) AS augmented, '<bos>' || text || chr(10) AS with_bos, 'Query: ' || text AS chat FROM benchmark")
def query_prompts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", T.augment_query(t, T.AUGMENTATION_TOKENS["qwen2"], "Query: ").alias("augmented"), T.with_bos(t).alias("with_bos"), T.chat_query(t).alias("chat"))


@query("SELECT item_id, '[{\"role\":\"user\",\"content\":[{\"type\":\"text\",\"text\":\"' || replace(replace(text, '\"', '\\\"'), chr(10), '\\n') || '\"}]}]' AS messages FROM benchmark")
def conversations_built(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.to_json(T.conversation("text", F.col("text"))).alias("messages"))


@query("SELECT doc_id, 'page_' || lpad((doc_id % 111 + 1)::VARCHAR, 3, '0') AS page, sha1('13:' || doc_id) AS hash, 'doc' || doc_id || '__single__clean' AS cache, replace(replace('Ġ' || source || '▁' || lang, 'Ġ', ' '), '▁', ' ') AS pretty FROM documents")
def names_and_hashes(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.page_name(d % 111 + 1).alias("page"), T.stable_hash(d, 13).alias("hash"), T.cache_key(F.concat(F.lit("doc"), d), F.lit("single"), F.lit(None).cast("string")).alias("cache"),
        T.pretty_token(F.concat(F.lit("Ġ"), "source", F.lit("▁"), "lang")).alias("pretty"),
    )


@query("SELECT item_id, '{\"queries\":[\"' || replace(replace(text, '\"', '\\\"'), chr(10), '\\n') || '\"]}' AS body FROM benchmark")
def endpoint_payloads(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.payload(None, F.array("text")).alias("body"))
