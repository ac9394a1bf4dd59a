"""The network's global configuration: JSON with a type at each level, read into typed rows.

Unknown keys are passed over; a wrong type, or a key or hash that isn't base64 of its length, is an error that names it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs

_BLOCK_TYPE = "struct<workchain: int, shard: long, seqno: long, root_hash: string, file_hash: string>"
SCHEMA = (
    "`@type` string, dht struct<`@type`: string, static_nodes: struct<`@type`: string, nodes: array<struct<`@type`: string, id: struct<`@type`: string, key: string>, "
    "addr_list: struct<`@type`: string, addrs: array<struct<`@type`: string, ip: long, port: int>>, version: long, reinit_date: long, expire_at: long>, version: long, signature: string>>>>, "
    f"validator struct<`@type`: string, zero_state: {_BLOCK_TYPE}, init_block: {_BLOCK_TYPE}, hardforks: array<{_BLOCK_TYPE}>>"
)
#: Types that the levels must state (fixed values).
TYPES = {"@type": "config.global", "dht.@type": "dht.config.global", "dht.static_nodes.@type": "dht.nodes", "validator.@type": "validator.config.global"}
NODE_TYPES = {"@type": "dht.node", "id.@type": "pub.ed25519", "addr_list.@type": "adnl.addressList"}


def _path(base: Column, dotted: str) -> Column:
    for part in dotted.split("."):
        base = base[part]
    return base


def _typed(at: Column, types: dict[str, str], value: Column) -> Column:
    """value, or an error where a level states another type."""
    out = value
    for path, want in types.items():
        found = F.coalesce(_path(at, path), F.lit("nothing"))
        out = F.when(found == want, out).otherwise(F.raise_error(F.concat(F.lit(f"{path} is "), found, F.lit(f", not {want}"))))
    return out


def _bytes(text: Column, n: int, what: str) -> Column:
    b = codecs.fixed_base64(text, n)
    return F.when(text.isNull() | b.isNotNull(), b).otherwise(F.raise_error(F.lit(f"{what} is no base64 of {n} bytes")).cast("binary"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """Configuration files -> one row a file: config, as typed JSON. The file has one object over many lines."""
    return spark.read.option("multiLine", True).schema(SCHEMA).json(path).select(F.struct("*").alias("config"))


def parsed(texts: DataFrame, col: str = "text") -> DataFrame:
    return texts.select(F.from_json(col, SCHEMA, {"mode": "FAILFAST"}).alias("config"))


def nodes(configs: DataFrame) -> DataFrame:
    """key, ip (dotted), port (of the first address), version, signature of every static node."""
    c = configs.select(_typed(F.col("config"), TYPES, F.col("config")).alias("config"))
    n = c.select(F.explode("config.dht.static_nodes.nodes").alias("n")).select(_typed(F.col("n"), NODE_TYPES, F.col("n")).alias("n"))
    first = F.element_at("n.addr_list.addrs", 1)
    ip = first["ip"].cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    dotted = F.concat_ws(".", *[F.shiftright(ip, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])
    return n.select(_bytes(F.col("n.id.key"), 32, "a node's key").alias("key"), dotted.alias("ip"), first["port"].alias("port"), F.col("n.version").alias("version"), _bytes(F.col("n.signature"), 64, "a node's signature").alias("signature"))


def _block(b: Column) -> list[Column]:
    return [b["workchain"].alias("workchain"), b["shard"].alias("shard"), b["seqno"].alias("seq_no"), _bytes(b["root_hash"], 32, "a root hash").alias("root_hash"), _bytes(b["file_hash"], 32, "a file hash").alias("file_hash")]


def blocks(configs: DataFrame) -> DataFrame:
    """role (zero_state, init_block, hardfork) and id of every block that the configuration names."""
    c = configs.select(_typed(F.col("config"), TYPES, F.col("config")).alias("config")).select("config.validator.*")
    one = lambda role: c.filter(F.col(role).isNotNull()).select(F.lit(role).alias("role"), *_block(F.col(role)))
    forks = c.select(F.explode("hardforks").alias("h")).select(F.lit("hardfork").alias("role"), *_block(F.col("h")))
    return one("zero_state").unionByName(one("init_block")).unionByName(forks)
