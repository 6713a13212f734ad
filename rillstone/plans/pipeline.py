"""The general data-pipeline queries (p1 to p7) over the test tables, with their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedupe, drift, feed, history, ledger, lww, orphans, reconcile
from ..session import load, micros, scratch_dir

IDS = ["actor_id", "film_id"]
ACTOR_TOPICS = ["debezium.mysql.sakila.sakila.actor", "debezium.postgres.dvdrental.public.actor"]
FILM_TOPIC = "debezium.mysql.sakila.sakila.film"


# 1 history -----------------------------------------------------------------------------------------------------------
def _address_versions(spark: SparkSession, d: str) -> DataFrame:
    digits = F.nullif(F.regexp_replace("phone", "[^0-9]", ""), F.lit(""))
    return history.update_history(load(spark, d, "address"), "address_id", digits, "last_update", "deleted_at")


def _actor_versions(spark: SparkSession, d: str) -> DataFrame:
    return history.snapshot_history(load(spark, d, "actor_extract"), "actor_id", "last_name", "last_update", "extracted_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Versions of actors' last names and addresses' phones with their validity."""
    parts = []
    for entity, rows, key in (("actor", _actor_versions(spark, d), "actor_id"), ("address", _address_versions(spark, d), "address_id")):
        parts.append(rows.select(F.lit(entity).alias("entity"), F.col(key).alias("entity_id"), F.col("valid_from").alias("valid_from_us"), F.col("valid_to").alias("valid_to_us")))
    return parts[0].unionByName(parts[1]).distinct()


def p1_actor_names(spark: SparkSession, d: str) -> DataFrame:
    """The versions of actors with the last name each holds."""
    return _actor_versions(spark, d).select("actor_id", "last_name", F.col("valid_from").alias("valid_from_us"), F.col("valid_to").alias("valid_to_us"))


def p1_actor_updates(spark: SparkSession, d: str) -> DataFrame:
    """Versions of last_update itself: the same method with the time as attribute."""
    x = load(spark, d, "actor_extract")
    x = x.withColumn("updated_us", micros(x, "last_update"))
    return history.snapshot_history(x, "actor_id", "updated_us", "last_update", "extracted_at").select("actor_id", "updated_us", F.col("valid_from").alias("valid_from_us"), F.col("valid_to").alias("valid_to_us"))


_P1_ACTOR = """
  x as (select actor_id, epoch_us(extracted_at) t, {attr} v, epoch_us(last_update) u from actor_extract where actor_id is not null and extracted_at is not null),
  e as (select t, row_number() over (order by t) n, coalesce(lead(t) over (order by t), -1) nxt from (select distinct t from x)),
  r as (select actor_id, t, v, u from x qualify row_number() over (partition by actor_id, t order by u desc nulls last, v desc nulls last) = 1),
  o as (select actor_id, n, v, coalesce(u, t) u, nxt from r join e using (t)),
  c as (select *, case when lag(n) over w = n - 1 and v is not distinct from lag(v) over w then 0 else 1 end chg from o window w as (partition by actor_id order by n)),
  i as (select *, sum(chg) over (partition by actor_id order by n) k from c),
  g as (select actor_id, k, min(n) n0, max(n) n1, arg_min(u, n) s, arg_max(nxt, n) c, any_value(v) v from i group by actor_id, k),
  va as (select actor_id, v, s, case when lead(n0) over w = n1 + 1 then lead(s) over w else c end e from g window w as (partition by actor_id order by k))
"""
P1_SQL = (
    "with"
    + _P1_ACTOR.format(attr="last_name")
    + """,
  ax as (select address_id, epoch_us(last_update) u, max(nullif(regexp_replace(phone, '[^0-9]', '', 'g'), '')) p, coalesce(max(epoch_us(deleted_at)), -1) del from address where address_id is not null and last_update is not null group by 1, 2),
  ac as (select *, case when row_number() over w > 1 and p is not distinct from lag(p) over w then 0 else 1 end chg from ax window w as (partition by address_id order by u)),
  ai as (select *, sum(chg) over (partition by address_id order by u) k from ac),
  ag as (select address_id, k, min(u) s, arg_max(del, u) c from ai group by 1, 2),
  av as (select address_id, s, coalesce(lead(s) over (partition by address_id order by k), c) e from ag)
select distinct 'actor' entity, actor_id entity_id, s valid_from_us, e valid_to_us from va
union select 'address', address_id, s, e from av"""
)
P1_NAMES_SQL = "with" + _P1_ACTOR.format(attr="last_name") + "select actor_id, v as last_name, s as valid_from_us, e as valid_to_us from va"
P1_UPDATES_SQL = "with" + _P1_ACTOR.format(attr="epoch_us(last_update)") + "select actor_id, v as updated_us, s as valid_from_us, e as valid_to_us from va"


# 2 duplicates --------------------------------------------------------------------------------------------------------
def _messages(spark: SparkSession, d: str) -> DataFrame:
    return feed.messages(load(spark, d, "change_feed"), IDS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every row of a message other than its first arrival."""
    return dedupe.extra_copies(_messages(spark, d), feed.IDENT, "arrived_us", "delivery_id")


def p2_messages(spark: SparkSession, d: str) -> DataFrame:
    """Exactly one copy of each message, of what a half of the files stored and the other half brings."""
    m = _messages(spark, d)
    old, new = m.filter("file_id % 2 = 0 or file_id is null"), m.filter("file_id % 2 = 1")
    return dedupe.deduplicate(old, new, feed.IDENT, "arrived_us", "delivery_id").select("delivery_id", "topic", "op", "entity_id", "file_no", "pos", "row_no", "lsn")


MESSAGES_SQL = """
  kk as (select *, coalesce(try_cast(json_extract_string(record_key, '$.actor_id') as bigint), try_cast(json_extract_string(record_key, '$.film_id') as bigint)) entity_id,
    try_cast(nullif(regexp_extract(source.file, '\\.([0-9]+)$', 1), '') as bigint) file_no from change_feed where source is not null and record_key is not null),
  mm as (select delivery_id, epoch_us(arrived_at) arrived_us, topic, op, source.name src_name, source."table" src_table, file_no, source.pos pos, cast(source."row" as bigint) row_no, source.lsn lsn, entity_id,
    row_number() over (partition by source.name, source."table", file_no, source.pos, source."row", source.lsn, entity_id order by arrived_at nulls last, delivery_id) rn from kk)
"""
P2_SQL = "with" + MESSAGES_SQL + "select delivery_id from mm where rn > 1"
P2_MESSAGES_SQL = "with" + MESSAGES_SQL + "select delivery_id, topic, op, entity_id, file_no, pos, row_no, lsn from mm where rn = 1"


# 3 orphans -----------------------------------------------------------------------------------------------------------
REFERENCES = (("address", "address_id", "city_id", "city", "city_id"), ("city", "city_id", "country_id", "country", "country_id"), ("store", "store_id", "address_id", "address", "address_id"))


def _misses(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for child, cid, ref, parent, key in REFERENCES:
        c, p = load(spark, d, child), load(spark, d, parent)
        live = c.filter(F.col("deleted_at").isNull()).select(cid, ref, micros(c, "loaded_at").alias("loaded_us"), F.date_format("last_update", "yyyy-MM").alias("period"))
        states = orphans.parent_states(p.select(key, micros(p, "loaded_at").alias("loaded_us"), "deleted_at"), key, "loaded_us", "deleted_at")
        got = orphans.orphans(live, states, cid, ref, "loaded_us", "period").select(F.lit(child).alias("child_table"), "child_id", "ref_id", "kind", "period")
        out = got if out is None else out.unionByName(got)
    return out


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """References that are missing, deleted or late, with the month of the referring row."""
    return _misses(spark, d)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """How many references are missing, deleted or late per table and month."""
    return orphans.report(_misses(spark, d))


_P3_ONE = """select distinct '{child}' child_table, c.{cid} child_id, c.{ref} ref_id, case when p.k is null then 'missing' when p.gone then 'deleted' else 'late' end kind, strftime(c.last_update, '%Y-%m') period
  from {child} c left join (select {key} k, min(loaded_at) l, count(deleted_at) > 0 gone from {parent} where {key} is not null group by 1) p on p.k = c.{ref}
  where c.deleted_at is null and c.{ref} is not null and (p.k is null or p.gone or p.l > c.loaded_at)"""
P3_SQL = "\nunion all ".join(_P3_ONE.format(child=c, cid=i, ref=r, parent=p, key=k) for c, i, r, p, k in REFERENCES)
P3_REPORT_SQL = f"select child_table, kind, period, count(*) cases, count(distinct ref_id) keys from ({P3_SQL}) group by all"


# 4 change feed -------------------------------------------------------------------------------------------------------
#: Names a field of the actors goes by in the feed.
ACTOR_FIELDS = {"first_name": ["first_name", "forename"], "last_name": ["last_name", "surname"], "last_update": ["last_update"]}


#: Values of the fields where every change sets the whole row.
WHOLE_ROW = {f: ("coalesce(" + ", ".join(f"doc.`{n}`" for n in names) + ")", "true") for f, names in ACTOR_FIELDS.items()}


def _actor_changes(spark: SparkSession, d: str) -> DataFrame:
    raw = load(spark, d, "change_feed").filter(F.col("topic").isin(ACTOR_TOPICS))
    m = feed.messages(raw, ["actor_id"])
    m = m.withColumn("seq", F.struct(F.coalesce("file_no", F.lit(0)).alias("wal_file"), F.coalesce("lsn", "pos").alias("wal_pos"), F.coalesce("row_no", F.lit(0)).alias("wal_row")))
    m = m.filter("entity_id is not null and seq.wal_pos is not null")
    names = [n for v in ACTOR_FIELDS.values() for n in v]
    doc = F.from_json("after", ", ".join(f"`{n}` string" for n in names))
    return m.select("topic", F.col("entity_id").alias("actor_id"), "seq", "op", doc.alias("doc"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Actors that exist at the end, with the position of the change that made their row: the latest of those that set its fields."""
    now = lww.apply_changes(_actor_changes(spark, d), ["topic", "actor_id"], "seq", "op", WHOLE_ROW, replace_ops=["r", "c", "u"], patch_ops=[], delete_ops=["d"], positions=True)
    return now.select("topic", "actor_id", F.greatest(*[f"{f}_at" for f in ACTOR_FIELDS]).alias("at")).select("topic", "actor_id", "at.*")


def p4_actors(spark: SparkSession, d: str) -> DataFrame:
    """The current actors with their fields: r, c and u set the whole row, so that a field left out is null."""
    now = lww.apply_changes(_actor_changes(spark, d), ["topic", "actor_id"], "seq", "op", WHOLE_ROW, replace_ops=["r", "c", "u"], patch_ops=[], delete_ops=["d"])
    return now.select("topic", "actor_id", *ACTOR_FIELDS)


def p4_merged_actors(spark: SparkSession, d: str) -> DataFrame:
    """The current actors if an update sets only the fields it brings with a value: last writer per column since the latest delete or replacement."""
    fields = {}
    for f, names in ACTOR_FIELDS.items():
        value = "coalesce(" + ", ".join(f"doc.`{n}`" for n in names) + ")"
        fields[f] = (value, f"{value} is not null")
    now = lww.apply_changes(_actor_changes(spark, d), ["topic", "actor_id"], "seq", "op", fields, replace_ops=["r", "c"], patch_ops=["u"], delete_ops=["d"])
    return now.select("topic", "actor_id", *ACTOR_FIELDS)


_P4_BASE = """
  kk as (select topic, op, after, try_cast(json_extract_string(record_key, '$.actor_id') as bigint) actor_id,
    coalesce(try_cast(nullif(regexp_extract(source.file, '\\.([0-9]+)$', 1), '') as bigint), 0) wal_file, coalesce(source.lsn, source.pos) wal_pos, coalesce(cast(source."row" as bigint), 0) wal_row
    from change_feed where source is not null and record_key is not null and op in ('r', 'c', 'u', 'd') and topic in ('debezium.mysql.sakila.sakila.actor', 'debezium.postgres.dvdrental.public.actor')),
  ch as (select * from kk where actor_id is not null and wal_pos is not null)
"""
_P4_LAST = _P4_BASE + ", la as (select * from ch qualify row_number() over (partition by topic, actor_id order by wal_file desc, wal_pos desc, wal_row desc, (op = 'd') desc) = 1)"
P4_SQL = "with" + _P4_LAST + " select topic, actor_id, wal_file, wal_pos, wal_row from la where op <> 'd'"
_J = "json_extract_string({a}, '$.{n}')"
_COAL = {f: "coalesce(" + ", ".join(_J.format(a="after", n=n) for n in names) + ")" for f, names in ACTOR_FIELDS.items()}
P4_ACTORS_SQL = (
    "with"
    + _P4_LAST
    + " select ch.topic, ch.actor_id, "
    + ", ".join(f"max({e.replace('(after', '(ch.after')}) as {f}" for f, e in _COAL.items())
    + " from la join ch on ch.topic = la.topic and ch.actor_id = la.actor_id and ch.wal_file = la.wal_file and ch.wal_pos = la.wal_pos and ch.wal_row = la.wal_row where la.op <> 'd' and ch.op <> 'd' group by all"
)
P4_MERGED_SQL = (
    "with"
    + _P4_BASE
    + """, cut as (select topic, actor_id, max((wal_file, wal_pos, wal_row)) filter (where op in ('r', 'c', 'd')) c, max((wal_file, wal_pos, wal_row)) filter (where op = 'd') g, max((wal_file, wal_pos, wal_row)) filter (where op <> 'd') s from ch group by all),
  al as (select ch.*, (wal_file, wal_pos, wal_row) q from ch join cut using (topic, actor_id) where op <> 'd' and (c is null or (wal_file, wal_pos, wal_row) >= c) and (g is null or s > g))
  select topic, actor_id, """
    + ", ".join(f"arg_max_null({e}, (q, {e} is not null, coalesce({e}, ''))) filter (where op in ('r', 'c') or {e} is not null) as {f}" for f, e in _COAL.items())
    + " from al group by all"
)


# 5 incremental -------------------------------------------------------------------------------------------------------
def _records(spark: SparkSession, d: str) -> dict[str, ledger.Source]:
    raw, x = load(spark, d, "change_feed"), load(spark, d, "actor_extract")
    # arrived_at as it lies in the files, so that windows reach the scan
    m = feed.messages(raw, IDS, "arrived_at")
    states = x.select("actor_id", micros(x, "last_update").alias("updated_us"), "arrived_at", "row_id")
    return {"change_feed": ledger.Source(m, feed.IDENT, "arrived_at", "delivery_id"), "actor_extract": ledger.Source(states, ["actor_id", "updated_us"], "arrived_at", "row_id")}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """What is new to each successful run, through a ledger of one work item per run and table."""
    log = load(spark, d, "run_log")
    # one row per successful run
    runs = log.filter("status = 'succeeded' and run_id is not null and read_upto is not null").select("run_id", micros(log, "read_upto").alias("upto")).distinct().collect()
    book = ledger.Ledger(spark, scratch_dir(spark, "incremental"))
    records = _records(spark, d)
    book.enqueue(ledger.run_windows([(r.run_id, r.upto) for r in runs], list(records)))
    while ledger.process(spark, book, records, "p5"):
        pass
    return book.results(spark, "run_id bigint, table_name string, row_id bigint")


P5_SQL = (
    "with"
    + MESSAGES_SQL
    + """,
  ss as (select row_id, epoch_us(arrived_at) arrived_us from actor_extract qualify row_number() over (partition by actor_id, last_update order by arrived_at nulls last, row_id) = 1),
  uu as (select run_id, min(epoch_us(read_upto)) upto from run_log where status = 'succeeded' and run_id is not null and read_upto is not null group by 1),
  ww as (select run_id, upto, lag(upto) over (order by upto, run_id) low from uu),
  rr as (select 'change_feed' table_name, delivery_id row_id, arrived_us from mm where rn = 1 union all select 'actor_extract', row_id, arrived_us from ss)
select run_id, table_name, row_id from rr join ww on arrived_us <= upto and (low is null or arrived_us > low)"""
)


# 6 drift -------------------------------------------------------------------------------------------------------------
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of a field of after, with the file where it starts."""
    return drift.changes_table(spark, load(spark, d, "change_feed"), load(spark, d, "feed_file"), IDS)


def p6_mysql_actor(spark: SparkSession, d: str) -> DataFrame:
    """The MySQL actor topic as one consistent table."""
    return drift.consistent_table(spark, load(spark, d, "change_feed"), load(spark, d, "feed_file"), ACTOR_TOPICS[0], IDS)


def p6_mysql_film(spark: SparkSession, d: str) -> DataFrame:
    """The film topic as one consistent table."""
    return drift.consistent_table(spark, load(spark, d, "change_feed"), load(spark, d, "feed_file"), FILM_TOPIC, IDS)


def p6_postgres_actor(spark: SparkSession, d: str) -> DataFrame:
    """The Postgres actor topic as one consistent table."""
    return drift.consistent_table(spark, load(spark, d, "change_feed"), load(spark, d, "feed_file"), ACTOR_TOPICS[1], IDS)


def _topic_sql(topic: str, columns: dict[str, tuple[str, list[str]]]) -> str:
    """A topic as one table, for columns (type, paths) known beforehand."""
    cells = []
    for name, (kind, paths) in columns.items():
        text = "coalesce(" + ", ".join(f"json_extract_string(a, '$.{p}')" for p in paths) + ")"
        cells.append((f"replace({text}, '\",\"', '\", \"')" if kind == "list" else text if kind == "string" else f"try_cast({text} as {kind})") + f" as {name}")
    return f"select delivery_id, file_id, {', '.join(cells)} from (select *, case when json_valid(after) then after end a from change_feed where topic = '{topic}')"


#: SQL of the consistent tables, for feeds that drift as the test tables do; tables that drift otherwise have other columns.
DRIFTED_ORACLE = {
    "p6_mysql_actor": _topic_sql(
        ACTOR_TOPICS[0],
        {"actor_id": ("bigint", ["actor_id"]), "contact_email": ("string", ["contact.email"]), "contact_phone": ("string", ["contact.phone", "contact.phone_no"]), "credits": ("double", ["credits"]), "fame": ("double", ["fame"]), "first_name": ("string", ["first_name"]),
         "is_active": ("string", ["is_active"]), "last_name": ("string", ["last_name", "surname"]), "last_update": ("string", ["last_update"]), "middle_name": ("string", ["middle_name"])},
    ),
    "p6_mysql_film": _topic_sql(
        FILM_TOPIC,
        {"description": ("string", ["description"]), "film_id": ("bigint", ["film_id"]), "language_id": ("bigint", ["language_id"]), "last_update": ("string", ["last_update"]), "length": ("bigint", ["length", "length_min"]), "original_language_id": ("bigint", ["original_language_id"]),
         "rating": ("string", ["rating", "age_rating"]), "release_year": ("string", ["release_year"]), "rental_duration": ("bigint", ["rental_duration"]), "rental_rate": ("string", ["rental_rate"]), "replacement_cost": ("string", ["replacement_cost"]),
         "special_features": ("list", ["special_features"]), "stock_level": ("bigint", ["stock_level"]), "tax_class": ("string", ["tax_class"]), "title": ("string", ["title"])},
    ),
    "p6_postgres_actor": _topic_sql(
        ACTOR_TOPICS[1],
        {"actor_id": ("string", ["actor_id"]), "contact_email": ("string", ["contact.email"]), "contact_phone": ("string", ["contact.phone"]), "credits": ("bigint", ["credits"]), "first_name": ("string", ["first_name", "forename"]), "guild": ("string", ["guild"]),
         "last_name": ("string", ["last_name"]), "last_update": ("string", ["last_update"])},
    ),
}


# 7 differences -------------------------------------------------------------------------------------------------------
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Actors lacking on either side and fields that differ."""
    sides = []
    for name in ("actor", "actor_replica"):
        t = load(spark, d, name)
        sides.append(t.select("actor_id", "first_name", "last_name", micros(t, "last_update").alias("last_update")))
    return reconcile.differences(*sides, "actor_id", ["first_name", "last_name", "last_update"], ("only_in_actor", "only_in_replica"))


P7_SQL = """
with a as (select distinct actor_id, first_name, last_name, epoch_us(last_update) last_update, 1 side from actor),
  b as (select distinct actor_id, first_name, last_name, last_update, 2 side from actor_replica),
  k as (select actor_id, bit_or(side) s from (from a union all from b) group by 1),
  v as (select actor_id, 'first_name' f, first_name v, side from (from a union all from b) union all select actor_id, 'last_name', last_name, side from (from a union all from b)
    union all select actor_id, 'last_update', cast(last_update as varchar), side from (from a union all from b)),
  o as (select actor_id, f, v, bit_or(side) s from v group by all having bit_or(side) < 3)
select actor_id, case s when 1 then 'only_in_actor' else 'only_in_replica' end difference from k where s < 3
union select o.actor_id, f from o join k on o.actor_id is not distinct from k.actor_id where k.s = 3"""


QUERIES = {f.__name__: f for f in (p1_found, p1_actor_names, p1_actor_updates, p2_found, p2_messages, p3_found, p3_report, p4_found, p4_actors, p4_merged_actors, p5_found, p6_found, p6_mysql_actor, p6_mysql_film, p6_postgres_actor, p7_found)}
ORACLE = {
    "p1_found": P1_SQL, "p1_actor_names": P1_NAMES_SQL, "p1_actor_updates": P1_UPDATES_SQL, "p2_found": P2_SQL, "p2_messages": P2_MESSAGES_SQL, "p3_found": P3_SQL, "p3_report": P3_REPORT_SQL,
    "p4_found": P4_SQL, "p4_actors": P4_ACTORS_SQL, "p4_merged_actors": P4_MERGED_SQL, "p5_found": P5_SQL, "p7_found": P7_SQL,
}
