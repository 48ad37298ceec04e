"""A database and frames to try the operators on, made from a table of events: a freight tram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buswright.sources.dbc import Catalog, parse

DBC = """VERSION "tram"

BO_ 289 Drive: 8 TCU
 SG_ Torque : 0|16@1- (0.5,0) [-16384|16383.5] "Nm" HMI
 SG_ Current : 23|12@0+ (0.1,-50) [-50|359.5] "A" HMI
 SG_ Notch : 24|3@1+ (1,0) [0|7] "" HMI
 SG_ Distance : 32|32@1+ (0.125,0) [0|0] "km" HMI

BO_ 1042 Doors: 8 DCU
 SG_ Boarded : 7|10@0+ (1,0) [0|1023] "" HMI
 SG_ Play : 8|6@1- (0.25,1) [-7|8.75] "mm" HMI
 SG_ State : 16|4@1- (1,0) [-8|7] "" HMI
 SG_ Cycles : 39|20@0+ (1,0) [0|0] "" HMI

BO_ 77 Climate: 8 HVAC
 SG_ Power : 0|12@1+ (0.05,0) [0|204.75] "kW" HMI
 SG_ CabinAir m2 : 16|12@1- (0.1,0) [0|0] "degC" HMI
 SG_ Zone M : 12|4@1+ (1,0) [0|15] "" HMI
 SG_ StoreAir m9 : 16|12@1- (0.1,-20) [0|0] "degC" HMI
 SG_ Humidity m9 : 28|8@1+ (0.5,0) [0|127.5] "%" HMI

BO_ 2327633409 Faults: 8 TCU
 SG_ Severity : 4|3@1+ (1,0) [0|7] "" HMI
 SG_ Counter : 15|56@0+ (1,0) [0|0] "" HMI

BO_ 1500 Parked: 8 TCU

VAL_ 1042 State -2 "Jammed" 0 "Closed" 3 "Open" 5 "" ;
VAL_ 77 Zone 2 "Cabin" 9 "Cold store" ;
VAL_ 2327633409 Severity 1 "Minor" 4 "Stop, now" 7 "Unknown" ;
"""

BROKEN_DBC = """BO_ 18 Pump: 3 YARD
 SG_ Flow : 12|16@1+ (1,0) [0|0] "" X
 SG_ Valve : 0|8@1+ (1,0) [0|0] "" X
BO_ 19 Winch: 8 YARD
 SG_ Rope : 4|12@1+ (1,0) [0|0] "" X
 SG_ Pull : 14|6@1- (1,0) [0|0] "" X
 SG_ Angle : 31|12@0+ (1,0) [0|0] "" X
 SG_ Tilt : 36|8@1+ (1,0) [0|0] "" X
BO_ 20 Crane: 8 YARD
 SG_ Axis M : 0|4@1+ (1,0) [0|0] "" X
 SG_ Hook m1 : 8|10@1+ (1,0) [0|0] "" X
 SG_ Boom m2 : 8|10@1+ (1,0) [0|0] "" X
 SG_ Reach m2 : 16|8@1+ (1,0) [0|0] "" X
BO_ 2415919122 Mast: 2 YARD
 SG_ Sway : 7|20@0- (1,0) [0|0] "" X
"""

#: The identifier of each type of event; 'error' has one that the database doesn't have.
IDS = {"click": 289, "purchase": 1042, "view": 77, "signup": 180149761}
UNKNOWN = 1999
#: The zones that climate frames name in turn; the third and fourth have no page.
ZONES = (2, 9, 5, 0)


def catalog() -> Catalog:
    return parse(DBC, "demo")


def frames(events: DataFrame) -> DataFrame:
    """A frame for each event: its type picks the identifier, its numbers the payload, some cut short."""
    v = F.round(F.col("value") * 100).cast("long")
    two = lambda x: F.lpad(F.hex(x % 256), 2, "0")
    four = lambda x: F.lpad(F.hex(x % 65536), 4, "0")
    rest = F.concat(four(F.col("user_id") * 7919), four(F.col("event_id")), four(v + F.col("user_id")))
    zone = F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.col("event_id") % len(ZONES) + 1).cast("int"))
    head = F.when(F.col("event_type") == "view", F.concat(two(v), two(zone * 16 + F.col("user_id") % 16))).otherwise(four(v))
    size = F.when(F.col("event_id") % 89 == 0, 0).when(F.col("event_id") % 97 == 0, 3).otherwise(8)
    can_id = F.lit(UNKNOWN)
    for name, number in IDS.items():
        can_id = F.when(F.col("event_type") == name, number).otherwise(can_id)
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("event_id").alias("line_no"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        can_id.cast("long").alias("can_id"),
        (F.col("event_type") == "signup").alias("is_extended"),
        F.unhex(F.substring(F.concat(head, rest), F.lit(1), size * 2)).alias("payload"),
        size.cast("int").alias("len"),
        F.lit(None).cast("int").alias("len8_dlc"),
    )


#: DuckDB's form of :func:`frames`, with the payload as hex digits ``h``.
FRAMES_SQL = f"""
f0 AS (
  SELECT event_id, ts, event_type, user_id, CAST(round(value * 100) AS BIGINT) AS v,
         CASE WHEN event_id % 89 = 0 THEN 0 WHEN event_id % 97 = 0 THEN 3 ELSE 8 END AS len
  FROM events
), f1 AS (
  SELECT *, printf('%04X', (user_id * 7919) % 65536) || printf('%04X', event_id % 65536) || printf('%04X', (v + user_id) % 65536) AS rest,
         CASE WHEN event_type = 'view' THEN printf('%02X', v % 256) || printf('%02X', {list(ZONES)}[event_id % {len(ZONES)} + 1] * 16 + user_id % 16) ELSE printf('%04X', v % 65536) END AS head
  FROM f0
), frames AS (
  SELECT event_id AS seq, epoch_us(ts) AS ts_us,
         CAST(CASE event_type {" ".join(f"WHEN '{k}' THEN {n}" for k, n in IDS.items())} ELSE {UNKNOWN} END AS BIGINT) AS can_id,
         event_type = 'signup' AS is_extended, substr(head || rest, 1, 2 * len) AS h, len
  FROM f1
)
"""


#: Parts of one database of :func:`databases`; one of so many databases can't be read.
PARTS, BAD_ONE = 10, 13


def databases(parts: DataFrame) -> DataFrame:
    """db and content: databases with a message for each part, ten parts each, laid out by the part's numbers.

    Many of their signals overlap or need more bytes than the message has, and some
    databases have a line that can't be read.
    """
    k, z, r = F.col("p_partkey"), F.col("p_size"), F.floor("p_retailprice").cast("long")
    raw = F.when(k % 7 == 0, F.lit(1 << 31) + k % 536870912).otherwise(k % PARTS + 1)
    signal = lambda name, mux, start, length, order, sign: F.concat(F.lit(f" SG_ {name}"), mux, F.lit(" : "), start.cast("string"), F.lit(f'|{length}@{order}{sign} (1,0) [0|0] "" X\n'))
    none = F.lit("")
    text = F.concat(
        F.lit("BO_ "), raw.cast("string"), F.lit(" Part"), k.cast("string"), F.lit(": 8 SHOP\n"),
        signal("Size", none, z % 40, 12, 1, "+"),
        signal("Price", none, r % 50, 10, 1, "-"),
        signal("Brand", none, k % 64, 9, 0, "+"),
        signal("Pick", F.lit(" M"), F.lit(60), 4, 1, "+"),
        signal("Near", F.lit(" m1"), k % 5 + 40, 16, 1, "+"),
        signal("Far", F.concat(F.lit(" m"), (k % 2 + 1).cast("string")), k % 3 + 44, 12, 1, "-"),
    )
    group = F.call_function("div", k, F.lit(PARTS))
    rows = parts.select(group.alias("group"), F.struct(k.alias("k"), text.alias("text")).alias("row"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda x: x["text"]), "")
    bad = F.when(F.col("group") % BAD_ONE == 5, "BO_ 2047 Lost: 1 X\n SG_ Lost\n").otherwise("")
    return rows.groupBy("group").agg(lines.alias("lines")).select(F.concat(F.lit("shop"), F.col("group").cast("string")).alias("db"), F.concat(bad, F.col("lines")).alias("content"))


#: DuckDB's form of the signals of :func:`databases` that can be read: ``s`` with a row a signal.
DATABASES_SQL = f"""
p AS (
  SELECT p_partkey AS k, 'shop' || CAST(p_partkey // {PARTS} AS VARCHAR) AS db, p_size AS z, CAST(floor(p_retailprice) AS BIGINT) AS r,
         p_partkey % 7 = 0 AS is_extended, 'Part' || CAST(p_partkey AS VARCHAR) AS message
  FROM part WHERE (p_partkey // {PARTS}) % {BAD_ONE} <> 5
), s AS (
  SELECT k, db, is_extended, message, 8 AS dlc, unnest([
    {{'name': 'Size', 'ix': 0, 'start': z % 40, 'n': 12, 'motorola': 0, 'signed': 0, 'page': NULL}},
    {{'name': 'Price', 'ix': 1, 'start': r % 50, 'n': 10, 'motorola': 0, 'signed': 1, 'page': NULL}},
    {{'name': 'Brand', 'ix': 2, 'start': k % 64, 'n': 9, 'motorola': 1, 'signed': 0, 'page': NULL}},
    {{'name': 'Pick', 'ix': 3, 'start': 60, 'n': 4, 'motorola': 0, 'signed': 0, 'page': NULL}},
    {{'name': 'Near', 'ix': 4, 'start': k % 5 + 40, 'n': 16, 'motorola': 0, 'signed': 0, 'page': 1}},
    {{'name': 'Far', 'ix': 5, 'start': k % 3 + 44, 'n': 12, 'motorola': 0, 'signed': 1, 'page': k % 2 + 1}}], recursive := true)
  FROM p
)
"""
