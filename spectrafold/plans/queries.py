"""The operators as queries over the driver's tables, each beside its SQL.

Stand-ins: peaks are line items (block = supplier, mz = extended price, intensity =
quantity), scans are events in order of event_id, axes are embeddings, sequences and
symbols come from texts, identifiers and paths from urls, tags from html.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import bounded_batches
from ..functions import codecs as K
from ..functions import columns as C
from ..operators import ordered as O
from ..operators import peaks as P
from . import convert

_QUERIES: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_suppkey").alias("block"), F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("l"))


_PEAKS = "(SELECT l_suppkey AS block, l_extendedprice AS mz, l_quantity AS intensity, l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS l FROM lineitem)"
_ORDER = ("mz", "o", "l")


@query(f"SELECT block, o, l, intensity FROM {_PEAKS} WHERE intensity >= 2")
def peak_zero_filter(spark, d):
    # no quantity is below 0.01, so the floor is 2 quantities here
    return peaks(spark, d).filter(C.keeps_peak(F.col("intensity") / 200)).select("block", "o", "l", "intensity")


@query(f"SELECT block, o, l FROM {_PEAKS} WHERE block IN (SELECT block FROM {_PEAKS} GROUP BY block HAVING count(*) >= 590)")
def scan_min_peaks(spark, d):
    return P.min_peaks(peaks(spark, d), least=590).select("block", "o", "l")


@query(f"SELECT block, o, l, CAST(round(mz * 1000) AS BIGINT) AS q FROM {_PEAKS}")
def mz_quantize(spark, d):
    return peaks(spark, d).select("block", "o", "l", C.mz_quantize(F.col("mz")).alias("q"))


@query(f"SELECT block, max(abs(mz - round(mz * 1000) / 1000)) <= 0.0005000001 AS within, count(*) AS n FROM {_PEAKS} GROUP BY block")
def mz_roundtrip_error(spark, d):
    back = C.mz_dequantize(C.mz_quantize(F.col("mz")))
    return peaks(spark, d).groupBy("block").agg((F.max(F.abs(F.col("mz") - back)) <= 0.0005000001).alias("within"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT block, o, l, CAST(round(sqrt(intensity)) AS BIGINT) AS q, CAST(round(sqrt(intensity)) AS BIGINT) * CAST(round(sqrt(intensity)) AS BIGINT) AS back FROM {_PEAKS}")
def intensity_sqrt_quantize(spark, d):
    q = C.sqrt_quantize(F.col("intensity"))
    return peaks(spark, d).select("block", "o", "l", q.alias("q"), C.sqrt_dequantize(q).alias("back"))


@query(f"SELECT block, o, l, CAST(round(sqrt((intensity - min(intensity) OVER (PARTITION BY block)) * 10000.0)) AS BIGINT) AS b FROM {_PEAKS}")
def baseline_sqrt(spark, d):
    return P.baseline(peaks(spark, d), "block", "intensity", C.baseline_sqrt).select("block", "o", "l", "b")


@query(f"SELECT block, o, l, CAST(round((intensity - min(intensity) OVER (PARTITION BY block)) * 100000.0) AS BIGINT) AS b FROM {_PEAKS}")
def baseline_linear(spark, d):
    return P.baseline(peaks(spark, d), "block", "intensity", C.baseline_linear).select("block", "o", "l", "b")


_SUMS = f"SELECT block, o, l, mz, CAST(round(sqrt(intensity)) AS BIGINT) AS d, CAST(sum(CAST(round(sqrt(intensity)) AS BIGINT)) OVER (PARTITION BY block ORDER BY mz, o, l ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM {_PEAKS}"


@query(f"SELECT block, o, l, d, total FROM ({_SUMS})")
def prefix_sum(spark, d):
    q = P.quantize(peaks(spark, d))
    return P.prefix_sum(q, "d", "total", "block", *_ORDER).select("block", "o", "l", "d", "total")


@query(f"SELECT block, o, l, total - lag(total, 1, 0) OVER (PARTITION BY block ORDER BY mz, o, l) AS d FROM ({_SUMS})")
def delta_decode(spark, d):
    summed = P.prefix_sum(P.quantize(peaks(spark, d)), "d", "total", "block", *_ORDER).drop("d")
    return P.delta_decode(summed, "total", "d", "block", *_ORDER).select("block", "o", "l", "d")


_WIDTH = "CASE WHEN u <= n THEN 0 ELSE CAST(ceil(log2(u / n)) AS BIGINT) END"
_EF = f"""SELECT block, o, l, q, row_number() OVER (PARTITION BY block ORDER BY q, o, l) - 1 AS i, n, {_WIDTH} AS width FROM
 (SELECT block, o, l, CAST(round(mz * 1000) AS BIGINT) AS q, count(*) OVER (PARTITION BY block) AS n,
  max(CAST(round(mz * 1000) AS BIGINT)) OVER (PARTITION BY block) AS u FROM {_PEAKS})"""


def _split(spark, d):
    return P.ef_split(P.quantize(peaks(spark, d)), "q", "block", "q", "o", "l")


@query(f"SELECT block, max(n) AS n, max(width) AS width, max(q // CAST(pow(2, width) AS BIGINT) + i) + 1 AS upper_bits FROM ({_EF}) GROUP BY block")
def ef_params(spark, d):
    return _split(spark, d).groupBy("block").agg(F.max("n").alias("n"), F.max(F.col("width").cast("long")).alias("width"), (F.max("bitpos") + 1).alias("upper_bits"))


@query(f"SELECT block, o, l, q // CAST(pow(2, width) AS BIGINT) AS hi, q % CAST(pow(2, width) AS BIGINT) AS lo, q // CAST(pow(2, width) AS BIGINT) + i AS bitpos FROM ({_EF})")
def ef_split(spark, d):
    return _split(spark, d).select("block", "o", "l", "hi", "lo", "bitpos")


@query(f"SELECT block, o, l, CAST(round(mz * 1000) AS BIGINT) AS q FROM {_PEAKS}")
def ef_join(spark, d):
    s = _split(spark, d)
    return s.select("block", "o", "l", ((F.col("bitpos") - F.col("i")) * F.pow(F.lit(2.0), "width").cast("long") + F.col("lo")).alias("q"))


def _coded(spark, d, word: int) -> DataFrame:
    rows = P.quantize(peaks(spark, d)).groupBy("block").agg(F.array_sort(F.collect_list("q")).alias("qs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"block": b["block"], "qs": [K.ef_decode(K.ef_encode(np.asarray(q, np.uint64), word), word).astype(np.int64) for q in b["qs"]]})

    bounded_batches(spark)
    back = rows.mapInPandas(run, "block long, qs array<long>")
    return back.select("block", F.posexplode("qs").alias("i", "q")).select("block", F.col("i").cast("long").alias("i"), "q")


_SORTED = f"SELECT block, row_number() OVER (PARTITION BY block ORDER BY q) - 1 AS i, q FROM (SELECT block, CAST(round(mz * 1000) AS BIGINT) AS q FROM {_PEAKS})"


@query(_SORTED)
def ef32_bytes_roundtrip(spark, d):
    return _coded(spark, d, 32)


@query(_SORTED)
def ef64_bytes_roundtrip(spark, d):
    return _coded(spark, d, 64)


@query("SELECT conv_id, turn, text FROM conversations")
def zstd_roundtrip(spark, d):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(text=[None if t is None else K.unzstd(K.zstd(t.encode())).decode() for t in b["text"]])

    bounded_batches(spark)
    return table(spark, d, "conversations").select("conv_id", "turn", "text").mapInPandas(run, "conv_id long, turn long, text string")


@query("SELECT conv_id, turn, base64(encode(text)) AS code FROM conversations")
def base64_encode(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", C.plain_base64(F.encode("text", "UTF-8")).alias("code"))


@query("SELECT conv_id, turn, decode(from_base64(base64(encode(text)))) AS text FROM conversations")
def base64_decode(spark, d):
    code = C.plain_base64(F.encode("text", "UTF-8"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.decode(F.unbase64(code), "UTF-8").alias("text"))


_RUNS = """SELECT run - 1 AS run_id, any_value(event_type) AS symbol, min(event_id) AS start, count(*) AS run FROM
 (SELECT event_id, event_type, CAST(sum(c) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM
  (SELECT event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) THEN 1 ELSE 0 END AS c FROM events)) GROUP BY run"""


@query(_RUNS)
def rle_encode(spark, d):
    r = O.runs(table(spark, d, "events"), "event_id", "event_type")
    return r.select((F.col("run_id") - 1).alias("run_id"), "symbol", "start", "run")


@query("SELECT event_id AS place, event_type AS symbol FROM events")
def rle_decode(spark, d):
    r = O.runs(table(spark, d, "events"), "event_id", "event_type")
    # event ids are consecutive within a run only by count, so places come from the ids themselves
    ids = table(spark, d, "events").agg(F.min("event_id").alias("first"))
    expanded = O.offsets(r, "run_id", F.col("run")).select("symbol", F.explode(F.sequence(F.col("offset"), F.col("offset") + F.col("run") - 1)).alias("k"))
    return expanded.crossJoin(F.broadcast(ids)).select((F.col("k") + F.col("first")).alias("place"), "symbol")


@query("""SELECT batch, symbol, n, row_number() OVER (PARTITION BY batch ORDER BY n DESC, symbol) - 1 AS rank FROM
 (SELECT event_id // 512 AS batch, event_type AS symbol, count(*) AS n FROM events GROUP BY ALL)""")
def symbol_rank(spark, d):
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 512).alias("batch"), F.col("event_type").alias("symbol"))
    return P.symbol_ranks(e, "batch", "symbol").select("batch", "symbol", "n", F.col("rank").cast("long").alias("rank"))


@query("""WITH e AS (SELECT event_id, event_id // 512 AS batch, event_type AS symbol FROM events),
 r AS (SELECT batch, symbol, row_number() OVER (PARTITION BY batch ORDER BY count(*) DESC, symbol) - 1 AS rank FROM e GROUP BY batch, symbol),
 m AS (SELECT *, CASE WHEN symbol IS DISTINCT FROM lag(symbol) OVER (PARTITION BY batch ORDER BY event_id) THEN 1 ELSE 0 END AS c FROM e),
 g AS (SELECT *, sum(c) OVER (PARTITION BY batch ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM m),
 p AS (SELECT batch, run, any_value(symbol) AS symbol, count(*) AS len FROM g GROUP BY batch, run)
 SELECT batch, CAST(run AS BIGINT) - 1 AS run, rank, len, CAST(sum(rank + len) OVER (PARTITION BY batch ORDER BY run ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM p JOIN r USING (batch, symbol)""")
def quality_codec_stream(spark, d):
    e = table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 512).alias("batch"), F.col("event_type").alias("symbol"))
    ranks = P.symbol_ranks(e, "batch", "symbol").select("batch", "symbol", F.col("rank").cast("long").alias("rank"))
    w = P.ordered("batch", "event_id")
    marked = e.withColumn("c", F.when(F.col("symbol").eqNullSafe(F.lag("symbol").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    numbered = P.prefix_sum(marked, "c", "run", "batch", "event_id")
    each = numbered.groupBy("batch", "run").agg(F.first("symbol").alias("symbol"), F.count(F.lit(1)).alias("len"))
    joined = each.join(ranks, ["batch", "symbol"]).withColumn("v", F.col("rank") + F.col("len"))
    return P.prefix_sum(joined, "v", "total", "batch", "run").select("batch", (F.col("run") - 1).alias("run"), "rank", "len", "total")


_LETTERS = "translate(text, 'aeiouAEIOU', 'ATGCNATGCN')"


def _sequences(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.translate("text", "aeiouAEIOU", "ATGCNATGCN").alias("s"))


@query(f"SELECT conv_id, turn, translate(regexp_replace({_LETTERS}, '[^ATGC]', 'A', 'g'), 'ATGC', '0123') AS codes FROM conversations")
def pack2bit_codes(spark, d):
    return _sequences(spark, d).select("conv_id", "turn", F.translate(F.regexp_replace("s", "[^ATGC]", "A"), "ATGC", "0123").alias("codes"))


@query(f"SELECT conv_id, turn, i - 1 AS place FROM (SELECT conv_id, turn, {_LETTERS} AS s, unnest(range(1, length({_LETTERS}) + 1)) AS i FROM conversations) WHERE substr(s, i, 1) NOT IN ('A', 'T', 'G', 'C')")
def n_positions(spark, d):
    letters = _sequences(spark, d).filter("s <> ''").select("conv_id", "turn", F.posexplode(F.split("s", "")).alias("place", "c"))
    return letters.filter("c <> '' AND c NOT IN ('A', 'T', 'G', 'C')").select("conv_id", "turn", F.col("place").cast("long").alias("place"))


@query(f"SELECT conv_id, turn, {_LETTERS} AS s FROM conversations")
def pack2bit_bytes_roundtrip(spark, d):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [s.encode() for s in b["s"]]
            yield b.assign(s=[K.unpack_bases(p, len(s), o, letters).decode() for s in raw for p, o, letters in [K.pack_bases(s)]])

    bounded_batches(spark)
    return _sequences(spark, d).mapInPandas(run, "conv_id long, turn long, s string")


@query("SELECT event_id // 512 AS batch, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM events GROUP BY ALL")
def read_batches(spark, d):
    batch = F.floor(F.col("event_id") / C.READS_PER_BATCH)
    return table(spark, d, "events").groupBy(batch.alias("batch")).agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id // 64 AS batch, string_agg(event_type, '' ORDER BY event_id) AS joined FROM events GROUP BY ALL")
def batch_concat(spark, d):
    e = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 64).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("s")))).alias("a"))
    return e.select("batch", F.array_join(F.transform("a", lambda x: x["s"]), "").alias("joined"))


# The text codecs over the long texts of documents.


def _documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _document_letters(spark, d) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.translate("text", "aeiouAEIOU", "ATGCNATGCN").alias("s"))


@query("SELECT doc_id, text FROM documents")
def zstd_roundtrip_documents(spark, d):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(text=[None if t is None else K.unzstd(K.zstd(t.encode())).decode() for t in b["text"]])

    bounded_batches(spark)
    return _documents(spark, d).mapInPandas(run, "doc_id long, text string")


@query("SELECT doc_id, base64(encode(text)) AS code FROM documents")
def base64_encode_documents(spark, d):
    return _documents(spark, d).select("doc_id", C.plain_base64(F.encode("text", "UTF-8")).alias("code"))


@query("SELECT doc_id, decode(from_base64(base64(encode(text)))) AS text FROM documents")
def base64_decode_documents(spark, d):
    code = C.plain_base64(F.encode("text", "UTF-8"))
    return _documents(spark, d).select("doc_id", F.decode(F.unbase64(code), "UTF-8").alias("text"))


@query(f"SELECT doc_id, translate(regexp_replace({_LETTERS}, '[^ATGC]', 'A', 'g'), 'ATGC', '0123') AS codes FROM documents")
def pack2bit_codes_documents(spark, d):
    return _document_letters(spark, d).select("doc_id", F.translate(F.regexp_replace("s", "[^ATGC]", "A"), "ATGC", "0123").alias("codes"))


@query(f"SELECT doc_id, i - 1 AS place FROM (SELECT doc_id, {_LETTERS} AS s, unnest(range(1, length({_LETTERS}) + 1)) AS i FROM documents) WHERE substr(s, i, 1) NOT IN ('A', 'T', 'G', 'C')")
def n_positions_documents(spark, d):
    letters = _document_letters(spark, d).filter("s <> ''").select("doc_id", F.posexplode(F.split("s", "")).alias("place", "c"))
    return letters.filter("c <> '' AND c NOT IN ('A', 'T', 'G', 'C')").select("doc_id", F.col("place").cast("long").alias("place"))


@query(f"SELECT doc_id, {_LETTERS} AS s FROM documents")
def pack2bit_bytes_roundtrip_documents(spark, d):
    def back(s: str) -> str:
        raw = s.encode()
        packed, escapes, letters = K.pack_bases(raw)
        return K.unpack_bases(packed, len(raw), escapes, letters).decode()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(s=[None if s is None else back(s) for s in b["s"]])

    bounded_batches(spark)
    return _document_letters(spark, d).mapInPandas(run, "doc_id long, s string")


@query("SELECT doc_id // 512 AS batch, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n FROM documents GROUP BY ALL")
def read_batches_documents(spark, d):
    batch = F.floor(F.col("doc_id") / C.READS_PER_BATCH)
    return _documents(spark, d).groupBy(batch.alias("batch")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id // 64 AS batch, string_agg(coalesce(text, ''), '' ORDER BY doc_id) AS joined FROM documents GROUP BY ALL")
def batch_concat_documents(spark, d):
    text = F.coalesce("text", F.lit(""))
    e = _documents(spark, d).groupBy(F.floor(F.col("doc_id") / 64).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("doc_id", text.alias("s")))).alias("a"))
    return e.select("batch", F.array_join(F.transform("a", lambda x: x["s"]), "").alias("joined"))


_TOKENS = "SELECT page_id, unnest(string_split(replace(replace(url, '/', ':'), ' ', ':\t:'), ':')) AS token, unnest(range(0, len(string_split(replace(replace(url, '/', ':'), ' ', ':\t:'), ':')))) AS pos, len(string_split(replace(replace(url, '/', ':'), ' ', ':\t:'), ':')) AS n FROM pages"
_TOKENS = f"SELECT page_id, pos, token FROM ({_TOKENS}) WHERE NOT (pos = n - 1 AND token = '')"


def _tokens(spark, d):
    ids = table(spark, d, "pages").select("page_id", C.id_tokens(F.replace("url", F.lit("/"), F.lit(":"))).alias("t"))
    return ids.select("page_id", F.posexplode("t").alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


@query(_TOKENS)
def id_tokenize(spark, d):
    return _tokens(spark, d).select("page_id", "pos", "token")


@query(f"SELECT page_id // 512 AS batch, pos, count(DISTINCT token) AS kinds, bool_and(regexp_full_match(token, '[0-9]*')) AS digits FROM ({_TOKENS}) GROUP BY ALL")
def id_column_class(spark, d):
    return _tokens(spark, d).groupBy(F.floor(F.col("page_id") / 512).alias("batch"), "pos").agg(F.count_distinct("token").alias("kinds"), F.bool_and(C.is_digits(F.col("token"))).alias("digits"))


@query(f"SELECT batch, pos, token, dense_rank() OVER (PARTITION BY batch, pos ORDER BY first) - 1 AS code FROM (SELECT page_id // 512 AS batch, pos, token, min(page_id) AS first FROM ({_TOKENS}) GROUP BY ALL)")
def id_dict_codes(spark, d):
    first = _tokens(spark, d).groupBy(F.floor(F.col("page_id") / 512).alias("batch"), "pos", "token").agg(F.min("page_id").alias("first"))
    code = F.dense_rank().over(P.Window.partitionBy("batch", "pos").orderBy("first")) - 1
    return first.select("batch", "pos", "token", code.cast("long").alias("code"))


@query("SELECT page_id, url FROM pages")
def identifier_codec_roundtrip(spark, d):
    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("page_id")
        key, code = K.encode_ids(b["url"].tolist())
        return pd.DataFrame({"page_id": b["page_id"], "url": K.decode_ids(key, code, len(b))})

    return table(spark, d, "pages").select("page_id", "url", F.floor(F.col("page_id") / 512).alias("batch")).groupBy("batch").applyInPandas(run, "page_id long, url string")


_CYCLES = "SELECT event_id, event_type, value, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS cycle_id FROM events"


def _cycles(spark, d):
    return O.cycle_ids(table(spark, d, "events"), "event_id", F.col("event_type") == "view")


@query(f"SELECT event_id, cycle_id FROM ({_CYCLES})")
def cycle_id(spark, d):
    return _cycles(spark, d).select("event_id", "cycle_id")


@query(f"SELECT event_id, cycle_id, event_type FROM ({_CYCLES}) WHERE cycle_id >= 0")
def drop_leading(spark, d):
    return _cycles(spark, d).filter("cycle_id >= 0").select("event_id", "cycle_id", "event_type")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS scan_index FROM events WHERE value >= 10")
def dense_index(spark, d):
    return O.dense_index(table(spark, d, "events").filter("value >= 10"), "event_id", "scan_index").select("event_id", "scan_index")


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def window_group_join(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("s_suppkey", "n_name", "r_name")


@query("SELECT o_orderkey, l_linenumber, o_orderstatus, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def frame_lookup(spark, d):
    o, li = table(spark, d, "orders").filter("o_orderstatus = 'F'"), table(spark, d, "lineitem")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select("o_orderkey", "l_linenumber", "o_orderstatus", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, p_partkey, p_size FROM lineitem JOIN part ON l_partkey = p_partkey AND l_quantity BETWEEN p_size AND p_size + 10")
def scan_range_join(spark, d):
    ranges = table(spark, d, "part").select(F.col("p_partkey").alias("r_l_partkey"), "p_size", (F.col("p_size") + 10).alias("high"))
    return P.range_join(table(spark, d, "lineitem"), ranges, "l_partkey", "l_quantity", "p_size", "high").select("l_orderkey", "l_linenumber", F.col("r_l_partkey").alias("p_partkey"), "p_size")


@query("SELECT n_nationkey, r_regionkey, row_number() OVER (ORDER BY n_nationkey, r_regionkey) - 1 AS place FROM nation CROSS JOIN region")
def cross_enumerate(spark, d):
    # cycles times experiments: two small dimensions
    pairs = table(spark, d, "nation").select("n_nationkey").crossJoin(table(spark, d, "region").select("r_regionkey"))
    return O.dense_index(pairs.withColumn("k", F.col("n_nationkey").cast("long") * 1000 + F.col("r_regionkey")), "k", "place").select("n_nationkey", "r_regionkey", "place")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'survey' WHEN 'click' THEN 'fragment' ELSE '' END AS name FROM events")
def dict_left_lookup(spark, d):
    names = spark.createDataFrame([("view", "survey"), ("click", "fragment")], "accession string, name string")
    return P.dictionary_join(table(spark, d, "events"), F.broadcast(names), "event_type", "accession", "name").select("event_id", "name")


@query("SELECT vec_id, CAST(embedding[(label % 60) + 1] AS FLOAT) AS a, CAST(embedding[(label % 60) + 3] AS FLOAT) AS b FROM embeddings")
def axis_gather(spark, d):
    got = P.gather(F.col("embedding"), F.array(F.col("label") % 60, F.col("label") % 60 + 2))
    return table(spark, d, "embeddings").select("vec_id", got.alias("g")).select("vec_id", F.get("g", F.lit(0)).alias("a"), F.get("g", F.lit(1)).alias("b"))


@query("SELECT vec_id, substr('!#%+5?AFI', (label % 9) + 1, 1) AS symbol FROM embeddings")
def symbol_gather(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.substring(F.lit("!#%+5?AFI"), (F.col("label") % 9 + 1).cast("int"), F.lit(1)).alias("symbol"))


@query(f"SELECT block, o, l, CAST(round(mz * 1000) AS BIGINT) AS q FROM {_PEAKS} WHERE block = 7")
def block_random_access(spark, d):
    return peaks(spark, d).filter("block = 7").select("block", "o", "l", C.mz_quantize(F.col("mz")).alias("q"))


@query("SELECT doc_id, length(text) AS len, CAST(sum(length(text)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - length(text) AS start FROM documents")
def offset_table(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("len"))
    return O.offsets(docs, "doc_id", F.col("len"), "start").select("doc_id", "len", "start")


@query("SELECT block, ntile(4) OVER (ORDER BY block) AS part FROM (SELECT DISTINCT l_suppkey AS block FROM lineitem)")
def entry_range_split(spark, d):
    blocks = O.dense_index(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("block")).distinct(), "block", "i")
    total = F.broadcast(blocks.agg(F.count(F.lit(1)).alias("n")))  # one row
    n, i = F.col("n"), F.col("i")
    size, more = F.floor(n / 4), n % 4
    part = F.when(i < more * (size + 1), F.floor(i / (size + 1))).otherwise(more + F.floor((i - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return blocks.crossJoin(total).select("block", (part + 1).cast("long").alias("part"))


@query("SELECT event_type, min_by(value, event_id) AS first, max_by(value, event_id) AS last FROM events GROUP BY ALL")
def first_last_rt(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min_by("value", "event_id").alias("first"), F.max_by("value", "event_id").alias("last"))


@query("SELECT i, count(DISTINCT floor(x * 10)) AS kinds FROM (SELECT unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY i HAVING count(DISTINCT floor(x * 10)) > 1")
def axis_all_equal(spark, d):
    places = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    return P.axes_agree(places, "i", "x", 1).select(F.col("i").cast("long").alias("i"), "kinds")


_KIND = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 2 WHEN 'purchase' THEN 9 ELSE 5 END"


def _kinds(spark, d):
    kind = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 9).otherwise(5)
    return table(spark, d, "events").withColumn("kind", kind)


@query(f"SELECT event_id, level FROM (SELECT event_id, CASE {_KIND} WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 9 THEN 2 ELSE -1 END AS level FROM events) WHERE level <> -1")
def msms_type_dispatch(spark, d):
    return _kinds(spark, d).select("event_id", C.ms_level_of(F.col("kind")).alias("level")).filter("level <> -1")


@query(f"SELECT {_KIND} AS kind, count(*) AS frames FROM events GROUP BY ALL")
def frame_counts(spark, d):
    return _kinds(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("frames"))


@query(f"SELECT max({_KIND}) AS max_type, max(user_id) AS max_scans FROM events")
def max_type(spark, d):
    return _kinds(spark, d).agg(F.max("kind").alias("max_type"), F.max("user_id").alias("max_scans"))


@query("SELECT max(CASE WHEN n_name = (SELECT min(n_name) FROM nation) THEN n_nationkey END) AS schema_type, max(CASE WHEN r_name IS NOT NULL THEN r_name END) AS instrument FROM nation CROSS JOIN region")
def metadata_pivot(spark, d):
    first = table(spark, d, "nation").agg(F.min_by("n_nationkey", "n_name").alias("schema_type"))
    return first.crossJoin(table(spark, d, "region").agg(F.max("r_name").alias("instrument")))


@query("""SELECT page_id, regexp_extract(html, '<a\\b[^>]*>', 0) AS tag, regexp_extract(regexp_extract(html, '<a\\b[^>]*>', 0), '\\bhref="([^"]*)"', 1) AS href FROM pages""")
def xml_attr_extract(spark, d):
    tag = F.regexp_extract("html", r"<a\b[^>]*>", 0)
    return table(spark, d, "pages").select("page_id", tag.alias("tag"), C.attribute(tag, "href").alias("href"))


_ATTRIBUTE = r'\b([a-zA-Z_:][-a-zA-Z0-9_:.]*)="([^"]*)"'
_LINKS = r"(SELECT page_id, unnest(regexp_extract_all(html, '<a\b[^>]*>')) AS tag, unnest(range(0, len(regexp_extract_all(html, '<a\b[^>]*>')))) AS place FROM pages)"


@query(f"SELECT page_id, place, tag, unnest(regexp_extract_all(tag, '{_ATTRIBUTE}', 1)) AS name, unnest(regexp_extract_all(tag, '{_ATTRIBUTE}', 2)) AS value FROM {_LINKS}")
def xml_attrs_of_all_tags(spark, d):
    """A row for each attribute of each link of a page; xml_attr_extract reads the first link only."""
    tags = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"<a\b[^>]*>"), F.lit(0))).alias("place", "tag"))
    part = lambda k: F.regexp_extract_all("tag", F.lit(_ATTRIBUTE), F.lit(k))
    each = tags.select("page_id", F.col("place").cast("long").alias("place"), "tag", F.explode(F.arrays_zip(part(1).alias("name"), part(2).alias("value"))).alias("p"))
    return each.select("page_id", "place", "tag", "p.name", "p.value")


@query("SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL")
def tag_scan(spark, d):
    tags = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, trim(string_split(translate(props, '{}",', ''), ':')[1]) AS key, trim(string_split(translate(props, '{}",', ''), ':')[2]) AS value FROM events""")
def keyvalue_parse(spark, d):
    kv = C.key_values(F.col("props"))
    return table(spark, d, "events").select("event_id", F.trim(F.get(kv, F.lit(0))).alias("key"), F.trim(F.get(kv, F.lit(1))).alias("value"))


@query("SELECT event_id // 512 AS batch, 'read_' || min(event_id) || '-' || max(event_id) AS title, min(event_id) AS a, max(event_id) AS b FROM events GROUP BY event_id // 512")
def title_parse(spark, d):
    titles = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 512).alias("batch")).agg(F.concat(F.lit("read_"), F.min("event_id"), F.lit("-"), F.max("event_id")).alias("title"))
    number = lambda k: F.regexp_extract("title", r"^read_(\d+)-(\d+)$", k).cast("long")
    return titles.select("batch", "title", number(1).alias("a"), number(2).alias("b"))


@query(r"SELECT page_id, lower(regexp_extract(url, '\.([^./\\]*)$', 1)) AS suffix FROM pages")
def suffix_route(spark, d):
    return table(spark, d, "pages").select("page_id", C.file_suffix(F.col("url")).alias("suffix"))


@query(r"SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '') AS stem FROM pages")
def stem(spark, d):
    return table(spark, d, "pages").select("page_id", C.file_stem(F.col("url")).alias("stem"))


@query("SELECT event_id, 1 AS level FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, 2 AS level FROM events WHERE event_type <> 'view'")
def union_levels(spark, d):
    e = table(spark, d, "events")
    return e.filter("event_type = 'view'").select("event_id", F.lit(1).alias("level")).unionByName(e.filter("event_type <> 'view'").select("event_id", F.lit(2).alias("level")))


@query("SELECT event_id, printf('PT%.2fS', value) AS duration FROM events")
def duration_format(spark, d):
    return table(spark, d, "events").select("event_id", C.duration_text(F.col("value")).alias("duration"))


@query("SELECT event_type, CAST(count_if(lower(event_type) NOT LIKE '%click%') AS BIGINT) AS ok, count(*) AS n FROM events GROUP BY ALL")
def success_count(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(~F.lower("event_type").like("%click%")).alias("ok"), F.count(F.lit(1)).alias("n"))


_COLLECT = f"SELECT block, count(*) AS n, string_agg(CAST(q AS VARCHAR), ',' ORDER BY q, o, l) AS qs FROM (SELECT block, o, l, CAST(round(mz * 1000) AS BIGINT) AS q FROM {_PEAKS}) GROUP BY block"


@query(_COLLECT)
def peak_collect(spark, d):
    packed = P.collect_peaks(P.quantize(peaks(spark, d)), "block", order=("q", "o", "l"))
    return packed.select("block", F.size("q").cast("long").alias("n"), F.array_join(F.transform("q", lambda x: x.cast("string")), ",").alias("qs"))


def _scans(spark, d) -> DataFrame:
    arrays = P.collect_peaks(peaks(spark, d), "block", order=("mz", "intensity", "o"))
    return arrays.select(F.col("block").alias("scan_index"), F.lit(1.5).cast("float").alias("rt"), F.lit(1).alias("ms_level"), F.lit(None).cast("int").alias("charge"), F.lit(None).cast("float").alias("precursor_mz"), F.lit(None).cast("float").alias("collision_energy"), "mz", "intensity")


_BACK = f"SELECT block, row_number() OVER (PARTITION BY block ORDER BY mz, intensity) - 1 AS i, CAST(round(mz * 1000) AS BIGINT) AS q, CAST(round(sqrt(intensity)) AS BIGINT) * CAST(round(sqrt(intensity)) AS BIGINT) AS x FROM {_PEAKS}"


def _blocks_back(spark, d, mode):
    back = convert.decode_scans(convert.encode_scans(convert.filter_scans(_scans(spark, d)), mode), mode)
    flat = back.select(F.col("block_id").alias("block"), F.posexplode(F.arrays_zip("mz", "intensity")).alias("i", "p"))
    return flat.select("block", F.col("i").cast("long").alias("i"), C.mz_quantize(F.col("p.mz")).alias("q"), F.col("p.intensity").cast("long").alias("x"))


@query(_BACK)
def binary_block(spark, d):
    return _blocks_back(spark, d, "binary")


@query(_BACK)
def json_block(spark, d):
    return _blocks_back(spark, d, "json")


@query(_BACK)
def yaml_block(spark, d):
    return _blocks_back(spark, d, "yaml")


@query("SELECT vec_id, count(*) AS n FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id")
def imaging_block(spark, d):
    """Spectra of both storage modes, whose errors stay within the bounds of their quantisation."""
    arrays = table(spark, d, "embeddings").select(F.col("vec_id").alias("spectrum_id"), *[F.lit(None).cast("float").alias(c) for c in ("pos_x", "pos_y", "pos_3dx", "pos_3dy", "pos_3dz")], F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda k: k.cast("double")).alias("mz"), F.transform("embedding", lambda x: x.cast("double")).alias("intensity"))
    processed = convert.decode_spectra(convert.encode_spectra(arrays)).select("spectrum_id", F.col("intensity").alias("p"))
    continuous = convert.decode_spectra(convert.encode_spectra(arrays, continuous=True), continuous=True).select("spectrum_id", F.col("intensity").alias("c"))
    both = arrays.join(processed, "spectrum_id").join(continuous, "spectrum_id")
    worst = lambda a: F.array_max(F.zip_with("intensity", a, lambda x, y: F.abs(x - y)))
    return both.filter((worst("p") < 2e-5) & (worst("c") < 0.05)).select(F.col("spectrum_id").alias("vec_id"), F.size("intensity").cast("long").alias("n"))


@query("SELECT conv_id * 100 + turn AS read_id, role AS identifier, text AS sequence FROM conversations")
def reads_block(spark, d):
    """Every letter beyond ATGC is an escape of the sequence codec."""
    reads = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("identifier"), F.col("text").alias("sequence"))
    dense = O.dense_index(reads, "id", "read_id")
    back = convert.decode_reads(convert.encode_reads(dense.select("read_id", "identifier", "sequence", F.lit("FF:").alias("quality"))))
    return back.join(dense.select("read_id", "id"), "read_id").select(F.col("id").alias("read_id"), "identifier", "sequence")


@query("SELECT doc_id AS read_id, coalesce(source, '') AS identifier, coalesce(text, '') AS sequence FROM documents")
def reads_block_documents(spark, d):
    """As reads_block, of the long texts; null texts are empty reads."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    dense = O.dense_index(table(spark, d, "documents").select("doc_id", text("source"), text("text")), "doc_id", "read_id")
    back = convert.decode_reads(convert.encode_reads(dense.select("read_id", F.col("source").alias("identifier"), F.col("text").alias("sequence"), F.lit("FF:").alias("quality"))))
    return back.join(dense.select("read_id", "doc_id"), "read_id").select(F.col("doc_id").alias("read_id"), "identifier", "sequence")


@query(r"SELECT page_id, CASE WHEN ends_with(p, '/') THEN p ELSE p || '/' END AS folder FROM (SELECT page_id, replace(replace(url, '/', '\\'), '\\', '/') AS p FROM pages)")
def path_normalize(spark, d):
    back = F.translate(F.translate("url", "/", "\\"), "\\", "/")
    return table(spark, d, "pages").select("page_id", F.when(back.endswith("/"), back).otherwise(F.concat(back, F.lit("/"))).alias("folder"))


@query("SELECT page_id, unnest(string_split(replace(url, '/', ';'), ';')) AS part FROM pages")
def list_split(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.split(F.replace("url", F.lit("/"), F.lit(";")), ";")).alias("part"))


@query(r"SELECT conv_id, turn, replace(text, ' ', '') AS joined, regexp_replace(text, '[\x00-\x1f]', ' ', 'g') AS clean FROM conversations")
def text_cleanup(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.replace("text", F.lit(" "), F.lit("")).alias("joined"), F.regexp_replace("text", r"[\x00-\x1f]", " ").alias("clean"))


@query("SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS number, TRY_CAST(event_type AS BIGINT) AS bad FROM events")
def number_parse(spark, d):
    return table(spark, d, "events").select("event_id", F.expr("try_cast(regexp_extract(props, '[0-9]+', 0) AS BIGINT)").alias("number"), F.expr("try_cast(event_type AS BIGINT)").alias("bad"))


@query("SELECT event_id, value * 60 AS seconds, CAST(round(event_id / 1048576.0 * 100) AS BIGINT) AS mb_hundredths FROM events")
def unit_conversion(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("value") * 60).alias("seconds"), F.round(F.col("event_id") / F.lit(1048576.0) * 100).cast("long").alias("mb_hundredths"))


@query("SELECT l_orderkey, l_linenumber, l_orderkey >> 3 AS hi, l_orderkey & 7 AS lo, ((l_orderkey >> 3) << 3) | (l_orderkey & 7) AS whole, l_orderkey % 32 AS bit FROM lineitem")
def bit_parts(spark, d):
    k = F.col("l_orderkey")
    hi, lo = F.shiftright(k, 3), k.bitwiseAND(F.lit(7).cast("long"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", hi.alias("hi"), lo.alias("lo"), F.shiftleft(hi, 3).bitwiseOR(lo).alias("whole"), (k % 32).alias("bit"))


@query("SELECT vec_id, list_min(embedding) AS least, len(embedding) AS n, embedding[3] AS third FROM embeddings")
def array_parts(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.array_min("embedding").alias("least"), F.size("embedding").cast("long").alias("n"), F.element_at("embedding", 3).alias("third"))


@query("SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings")
def axis_base64(spark, d):
    """A float axis as base64 text and back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(embedding=[K.base64_to_floats(K.floats_to_base64(x)) for x in b["embedding"]])

    bounded_batches(spark)
    back = table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, embedding array<float>")
    return back.select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS precursor FROM events")
def precursor_of_level(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("precursor"))


@query("SELECT user_id, min_by(event_type, event_id) AS first FROM events GROUP BY user_id")
def first_wins(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first"))


@query("SELECT o_orderkey, l_linenumber, o_orderpriority FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def frame_replication(spark, d):
    """A frame's record repeated for each of its rows."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return li.join(o, o["o_orderkey"] == li["l_orderkey"]).select("o_orderkey", "l_linenumber", "o_orderpriority")


@query("SELECT event_id, event_type, n FROM events JOIN (SELECT count(*) AS n FROM events) ON true")
def header_join(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "event_type").crossJoin(F.broadcast(e.agg(F.count(F.lit(1)).alias("n"))))  # one row


@query(f"SELECT block, o, l, row_number() OVER (ORDER BY block, o, l) - 1 AS place FROM {_PEAKS}")
def block_order(spark, d):
    """Places in the order of the block directory, over the whole table."""
    p = peaks(spark, d).select("block", "o", "l")
    return O.dense_index(p, "block", "place", ("o", "l"))


@query("""SELECT event_id, '{"id":' || event_id || ',"kind":"' || event_type || '"}' AS entry FROM events""")
def json_emit(spark, d):
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("entry"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_parse(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT source, count(*) AS n FROM (SELECT 'a' AS source FROM nation UNION ALL SELECT 'b' AS source FROM region) GROUP BY source")
def multi_file_append(spark, d):
    return table(spark, d, "nation").select(F.lit("a").alias("source")).unionByName(table(spark, d, "region").select(F.lit("b").alias("source"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(None)
def compression_report(spark, d):
    """Bytes in and out and the reduction in percent, by write mode; sizes depend on the codec library."""
    scans = convert.filter_scans(_scans(spark, d))
    sizes = [convert.encode_scans(scans, m).select(F.lit(m).alias("mode"), F.octet_length("payload").cast("long").alias("out")) for m in ("binary", "json", "yaml")]
    raw = scans.agg(F.sum(F.size("mz") * 16).alias("in_bytes"))
    out = sizes[0].unionByName(sizes[1]).unionByName(sizes[2]).groupBy("mode").agg(F.sum("out").alias("out_bytes"))
    return out.crossJoin(raw).withColumn("reduction", (1 - F.col("out_bytes") / F.col("in_bytes")) * 100)


@query(f"""SELECT o, l, block, q, i, n, width, q // CAST(pow(2, width) AS BIGINT) AS hi, q % CAST(pow(2, width) AS BIGINT) AS lo, q // CAST(pow(2, width) AS BIGINT) + i AS bitpos, total FROM
 (SELECT *, row_number() OVER (PARTITION BY block ORDER BY q, o, l) - 1 AS i, {_WIDTH} AS width,
  CAST(sum(d) OVER (PARTITION BY block ORDER BY q, o, l ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM
  (SELECT block, o, l, CAST(round(mz * 1000) AS BIGINT) AS q, CAST(round(sqrt(intensity)) AS BIGINT) AS d, count(*) OVER (PARTITION BY block) AS n,
   max(CAST(round(mz * 1000) AS BIGINT)) OVER (PARTITION BY block) AS u FROM {_PEAKS}
   WHERE intensity >= 2 AND block IN (SELECT block FROM {_PEAKS} GROUP BY block HAVING count(*) >= 10)))""")
def encode_plan(spark, d):
    """The flagship: filter, quantise, order, prefix sum and the Elias-Fano parts of every block."""
    kept = P.min_peaks(peaks(spark, d)).filter(C.keeps_peak(F.col("intensity") / 200))
    split = P.ef_split(P.quantize(kept), "q", "block", "q", "o", "l")
    out = P.prefix_sum(split, "d", "total", "block", "q", "o", "l")
    return out.select("o", "l", "block", "q", F.col("i").cast("long").alias("i"), "n", F.col("width").cast("long").alias("width"), "hi", "lo", "bitpos", "total")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _QUERIES.items() if s}
