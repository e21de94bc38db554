"""The seven store tables, derived from the star-schema and text tables of a data folder.

One set of SQL definitions serves both engines: `definitions` gives it as common table expressions, with the three functions
that the dialects name differently filled in. `tables` writes them as a snapshot in the shared folder once for each session
and data folder, and hands out the scans of that snapshot."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from satchel.operators import changes
from satchel.sources import session

SPARK = {"SHA": "sha2({}, 256)", "BYTES": "octet_length({})", "ISO": "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"}
DUCK = {"SHA": "sha256({})", "BYTES": "octet_length(encode({}))", "ISO": "strftime({}, '%Y-%m-%dT%H:%M:%S.%gZ')"}
RAW = ("documents", "events", "labels", "benchmark")
NAMES = ("items", "collections", "bindings", "queue", "objects", "sources", "meta")


def definitions(dialect: dict[str, str]) -> dict[str, str]:
    sha, size, iso = (lambda x, k=k: dialect[k].format(x) for k in ("SHA", "BYTES", "ISO"))
    return {
        "base": f"""
select d.doc_id, d.lang, d.source, cast(substr(d.source, 4) as int) as src_no, concat(d.lang, '/', d.source) as collection,
  case when d.doc_id % 5 = 0 then concat('uid:', cast(d.doc_id as varchar(20))) else concat('mid:', md5(coalesce(d.text, ''))) end as link_id,
  {sha("coalesce(d.text, '')")} as h, cast({size("coalesce(d.text, '')")} as bigint) as size, d.n_chars, coalesce(e.ts, timestamp '2024-01-01 00:00:00') as ts,
  case when l.quality = 1 and l.toxic = 1 then '["$flagged","$seen"]' when l.quality = 1 then '["$seen"]' when l.toxic = 1 then '["$flagged"]' else '[]' end as flags
from documents d left join events e on e.event_id = d.doc_id left join labels l on l.doc_id = d.doc_id""",
        "one": "select * from (select base.*, row_number() over (partition by collection, link_id order by doc_id) as rn from base) x where rn = 1",
        "firsts": "select link_id, min(doc_id) as first_doc from one group by link_id",
        "ranked": "select link_id, cast(row_number() over (order by first_doc, link_id) as bigint) as seq from firsts",
        "items": f"""
select collection, y.link_id, seq, flags,
  case when doc_id % 10 < 7 then h end as object_hash,
  case when doc_id % 10 < 9 then concat('{{"v":1,"lang":"', lang, '","n":', cast(n_chars as varchar(20)), '}}') end as meta,
  case when doc_id % 11 = 0 then '' else {iso("date_trunc('day', ts)")} end as sort_key,
  case when doc_id % 10 < 7 then 2 when doc_id % 10 < 9 then 1 else 0 end as level,
  case when doc_id % 7 = 0 or doc_id % 13 = 0 then 1 else 0 end as deleted,
  case when doc_id % 7 = 0 then {iso("ts")} end as retained_at,
  case when doc_id % 7 = 0 then 'left' end as retained_by,
  case when doc_id % 31 = 0 then 1 else 0 end as conflicted, cast(null as varchar(64)) as conflict_object
from one y join ranked r on r.link_id = y.link_id""",
        "collections": """
select collection as id, nullif(lang, 'en') as account, case when src_no % 7 = 0 then '' else 'text/plain' end as kind, collection as name,
  cast(null as varchar(64)) as parent, case when src_no % 3 = 0 then null else src_no end as sort_order, 'manual' as conflict, 1 + src_no % 2 as generation
from (select distinct collection, lang, src_no from one) c
union all select 'zz/empty', 'zz', 'text/vcard', 'zz/empty', 'en/src1', null, 'prefer-incoming', 1""",
        "bindings": """
select collection, link_id, s.source, concat(upper(substr(s.source, 1, 1)), cast(seq as varchar(20))) as handle,
  case when seq % 4 = 0 then '[]' else flags end as base_flags, object_hash as base_object,
  case when seq % 3 = 0 then concat('r', cast(seq as varchar(20))) end as base_revision,
  case when seq % 29 = 0 then 1 else 0 end as conflicted, case when seq % 29 = 0 then concat('c', cast(seq as varchar(20))) end as conflict_revision
from items cross join (select 'left' as source union all select 'right') s
where retained_at is null and ((s.source = 'left' and deleted = 0) or (s.source = 'right' and (deleted = 1 or seq % 2 = 0)))
union all select 'zz/gone', 'mid:dangling', 'left', 'L0', '[]', null, null, 0, null""",
        "targets": "select seq, min(collection) as collection, min(object_hash) as object_hash from items where retained_at is null group by seq",
        "queue": f"""
select cast(e.event_id as bigint) + 1 as id, {iso("e.ts")} as created_at, concat('user-', cast(e.user_id as varchar(20))) as producer, t.collection,
  case e.event_type when 'click' then 'set-flags' when 'view' then 'copy' when 'purchase' then 'update' when 'signup' then 'remove' else case when e.value >= 100 then 'remove' else 'submit' end end as action,
  case e.event_type when 'click' then concat('{{"v":1,"seq":', cast(t.seq as varchar(20)), ',"flags":["$seen"]}}')
    when 'view' then concat('{{"v":1,"seq":', cast(t.seq as varchar(20)), ',"to":"zz/empty"}}')
    when 'purchase' then case when t.object_hash is null then concat('{{"v":1,"seq":', cast(t.seq as varchar(20)), '}}') else concat('{{"v":1,"seq":', cast(t.seq as varchar(20)), ',"object":"', t.object_hash, '"}}') end
    when 'signup' then concat('{{"v":1,"seq":', cast(t.seq as varchar(20)), '}}')
    else case when e.value >= 100 then 'nope' else '{{"v":1,"to":["a@b.c"]}}' end end as payload,
  case when e.event_type = 'purchase' then t.object_hash end as object_hash,
  case when e.event_type = 'error' and e.value < 20 then 1 else 0 end as attempts,
  case when e.event_type = 'error' and e.value < 20 then 'unknown seq: 9999' end as error
from events e join targets t on t.seq = e.user_id + 1""",
        "refs": """
select object_hash as hash from items where object_hash is not null union all select conflict_object from items where conflict_object is not null
union all select base_object from bindings where base_object is not null union all select object_hash from queue where object_hash is not null""",
        "objects": f"""
select r.hash, s.size, r.n + case when substr(r.hash, 1, 1) = '0' then 1 else 0 end as refcount
from (select hash, count(*) as n from refs group by hash) r join (select h, max(size) as size from base group by h) s on s.h = r.hash
where substr(r.hash, 1, 1) <> 'f'
union all select {sha("b.text")}, cast({size("b.text")} as bigint), 0 from benchmark b""",
        "sources": "select distinct collection, source, concat(collection, '@', source) as checkpoint from bindings where collection <> 'zz/gone'",
        "meta": "select 1 as id, 'satchel' as format, 1 as version, 'sha256' as hash_algo, cast(max(seq) + 1 as bigint) as next_seq from items",
        "blobs": """
select distinct h as hash, size from base where substr(h, 1, 1) <> 'e' union all select concat('orphan-', cast(item_id as varchar(20))), cast(length(text) as bigint) from benchmark""",
    }


def oracle(select: str) -> str:
    """DuckDB SQL over the store tables."""
    return "with " + ",\n".join(f"{name} as ({text})" for name, text in definitions(DUCK).items()) + "\n" + select


_OPEN: dict[str, tuple[SparkSession, dict[str, DataFrame]]] = {}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The store tables of a data folder, by name; blobs lists what lies in the blob folder. The scans are kept for the session, so
    files are listed and schemas read once; a session that has been stopped has its tables written anew."""
    if sf_dir in _OPEN and _OPEN[sf_dir][0] is spark and spark.sparkContext._jsc is not None:
        return dict(_OPEN[sf_dir][1])
    raw = {n: f"select * from parquet.`{sf_dir}/{n}.parquet`" for n in RAW}
    own = definitions(SPARK)
    done: dict[str, str] = {}
    scans: dict[str, DataFrame] = {}

    def sql(name: str) -> DataFrame:
        ctes = [*raw.items(), *((n, f"select * from parquet.`{done[n]}`" if n in done else t) for n, t in own.items())]
        return spark.sql("with " + ", ".join(f"{n} as ({t})" for n, t in ctes) + f" select * from {name}")

    def write(name: str) -> tuple[str, str, DataFrame]:
        # the numbers of links are given by ranges, not by one window
        df = changes.numbered(sql("firsts"), ["first_doc", "link_id"], 1, "seq").select("link_id", "seq") if name == "ranked" else sql(name)
        path = session.fresh_path(spark, name)
        df.write.parquet(path)
        return name, path, spark.read.schema(df.schema).parquet(path)

    # each step needs the steps before; what is in one step runs at once
    with ThreadPoolExecutor(4) as pool:
        for step in (("base",), ("ranked", "collections", "blobs"), ("items",), ("bindings", "queue", "meta"), ("objects", "sources")):
            found = list(pool.map(write, step))
            done |= {name: path for name, path, _ in found}
            scans |= {name: df for name, _, df in found if name != "ranked"}
    _OPEN[sf_dir] = (spark, scans)
    return dict(scans)
