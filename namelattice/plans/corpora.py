"""Names derived from tables that are no point lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.points import name_lines

#: Units of a made-up plant: the kind of a unit, by its supplier's number, and its children; a child may have children.
KINDS = [
    {"AHUX": {m: [] for m in "MATP RATP OATP HUMI DMPR FANS COIL FILT PUMP VALV".split()}},
    {"VAVX": {m: [] for m in "ZNTP OCCU STPT FLOW HEAT COOL BOXS REHT PRES ALRM".split()}},
    {"VRFX": {m: [] for m in "ZNTM OUTT SETP OCCP MODE LOAD CMPR EXPV DEFR STAT".split()}},
    {"PLNT": {"TOWR": ["BASN", "SPRY", "DRFT"], "BOIL": ["BURN", "DRUM", "FLUE"], "ZONE": "ZNTP OCCU STPT FLOW HEAT COOL BOXS REHT PRES ALRM".split()} | {m: [] for m in "CHLR PIPE TANK METR MAIN VENT SUMP".split()}},
    {"TWIN": {m: [] for m in "TWNA TWNB TWNC TWND TWNE TWNF TWNG TWNH TWNI".split()} | {"TWNJ": "TWNA TWNB TWNC TWND TWNE TWNF TWNG TWNH".split()}},
]
#: Rows of (kind, unit, place of the member, member, its child or null).
PLANT_ROWS = [
    (k, unit, at, member, child)
    for k, kind in enumerate(KINDS)
    for unit, members in kind.items()
    for at, (member, children) in enumerate(members.items())
    for child in (children or [None])
]
#: Which unit has which members: most have all, others lack one or have others in place of one or two. The same text in both engines.
PLANT_MEMBER = """CASE WHEN s_suppkey % 6 = 3 AND place = s_suppkey % 10 THEN 'XTRA' WHEN s_suppkey % 6 = 5 AND place = s_suppkey % 10 THEN 'XTRB'
  WHEN s_suppkey % 6 = 5 AND place = (s_suppkey + 3) % 10 THEN 'XTRC' ELSE member END"""
PLANT_UNIT = "concat(unit, lpad(cast(s_suppkey AS {text}), 6, '0'))"
PLANT_HAS = "NOT (s_suppkey % 6 = 4 AND place = s_suppkey % 10)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, corpus: str) -> DataFrame:
    """``value``: a name a line."""
    if corpus == "pages":
        return _table(spark, sf_dir, "pages").select(F.col("url").alias("value"))
    if corpus == "parts":
        return _table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_type", "p_name").alias("value")).distinct()
    if corpus == "supply":
        sold = _table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
        typed = sold.join(_table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_type").distinct()
        named = typed.join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        placed = named.join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return placed.select(F.concat_ws("/", "r_name", "n_name", "s_name", "p_type").alias("value")).distinct()
    if corpus == "plant":
        rows = spark.createDataFrame(PLANT_ROWS, "kind int, unit string, place int, member string, child string")
        # A supplier makes many names, so a small file of suppliers is not work for one task.
        suppliers = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")
        units = suppliers.join(F.broadcast(rows), F.col("s_suppkey") % len(KINDS) == F.col("kind")).where(PLANT_HAS)
        units = units.join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        unit = F.expr(PLANT_UNIT.format(text="string"))
        return units.select(F.concat_ws("/", F.replace("n_name", F.lit(" ")), unit, F.expr(PLANT_MEMBER), "child").alias("value")).distinct()
    if corpus == "orders":
        return _table(spark, sf_dir, "orders").select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("value")).distinct()
    raise ValueError(corpus)


def points(spark: SparkSession, sf_dir: str, corpus: str) -> DataFrame:
    return name_lines(lines(spark, sf_dir, corpus))[0]
