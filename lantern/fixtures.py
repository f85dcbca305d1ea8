"""Catalog tables derived from the test tables by SQL that Spark and DuckDB both run.

The same text serves the queries (through Spark) and their oracles (as common table expressions in DuckDB), but for
_SPARK; what an operator computes on them is written twice, independently.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from lantern.tables import written

_TABLES = ("region", "nation", "supplier", "lineitem", "orders", "events", "part", "documents")

CTES = {
    "f_base": """select l_orderkey*8+l_linenumber as file_id, min(l_partkey) as pk, min(l_suppkey) as sk,
        cast(min(l_quantity) as bigint) as q, min(l_shipdate) as mt from lineitem group by l_orderkey, l_linenumber""",
    "f_named": """select b.*, r_regionkey+1 as location_id,
        concat(case when n_nationkey % 10 = 3 then '.' else '' end, lower(n_name), '/', lower(replace(s_name,'#','_')), '/', year(mt)) as rel_dir,
        case when pk % 12 = 10 then concat('.cfg', file_id) when pk % 12 = 9 then concat('README', file_id)
             else concat('f_', file_id, '.', ext) end as filename
        from (select f_base.*, case pk % 12 when 0 then 'jpg' when 1 then 'JPEG' when 2 then 'mp4' when 3 then 'mp3' when 4 then 'pdf'
              when 5 then 'txt' when 6 then 'zip' when 7 then 'ttf' when 8 then 'xyz' else 'png' end as ext from f_base) b
        join supplier on s_suppkey=sk join nation on n_nationkey=s_nationkey join region on r_regionkey=n_regionkey""",
    "f_raw": """select cast(file_id as bigint) as file_id, cast(location_id as bigint) as location_id, rel_dir, filename, concat(rel_dir,'/',filename) as rel_path, pk, q,
        cast(case when q=1 then 0 else q*8192 end as bigint) as file_size, cast(mt as timestamp) as modified_at,
        case when file_id % 31 = 0 then 1 else 0 end as stale, case when file_id % 29 = 0 then 1 else 0 end as excluded from f_named""",
    "f_line": """select f_raw.*, case when file_size=0 then null when file_size<=131072 then substr(md5(concat(pk,'|',q)),1,16)
        else substr(md5(concat(pk % 100,'|',q)),1,16) end as hash_partial,
        case when file_size=0 then null else substr(md5(concat(pk,'|',q)),1,16) end as content_fast,
        case when file_size>0 and file_id % 5 = 0 then SHA256(concat(pk,'|',q)) end as hash_strong,
        case when filename like '.%' or rel_dir like '.%' then 1 else 0 end as hidden,
        case pk % 12 when 0 then 'image' when 1 then 'image' when 2 then 'video' when 3 then 'audio' when 4 then 'document' when 5 then 'text'
          when 6 then 'compressed' when 7 then 'font' when 10 then 'text' when 11 then 'image' else 'other' end as type_high,
        cast(file_id * 7919 % 1000003 as bigint) as inode, case when file_id % 7 = 0 then null else file_id % 3 end as scan_id,
        case when file_id % 10 = 0 then concat('note ', pk % 50) end as description from f_raw""",
    # hashes as they stand before the funnel (fast known for a third) and after it (known for all that have content)
    "f_hashes0": """select file_id, location_id, file_size, hash_partial, case when file_id % 3 = 0 then content_fast end as hash_fast, hash_strong,
        cast(0 as bigint) as dup_count, excluded, stale from f_line""",
    "f_hashes": """select file_id, location_id, file_size, hash_partial, content_fast as hash_fast, hash_strong,
        cast(file_id % 4 as bigint) as dup_count, excluded, stale from f_line""",
    "f_locations": """select cast(r_regionkey+1 as bigint) as location_id, r_name as name, concat('/mnt/', lower(r_name)) as root_path, r_regionkey % 2 = 0 as online,
        case when r_regionkey % 2 = 1 then concat('agent', r_regionkey) end as agent_name from region""",
    "f_folders": """select distinct location_id, rel_path from (
        select location_id, split_part(rel_dir,'/',1) as rel_path from f_line
        union all select location_id, concat(split_part(rel_dir,'/',1),'/',split_part(rel_dir,'/',2)) as rel_path from f_line
        union all select location_id, rel_dir as rel_path from f_line union all select location_id, 'empty' as rel_path from f_locations) u""",
    "f_listing": """select location_id, rel_dir, filename, concat(rel_dir,'/',filename) as rel_path, file_size, modified_at from (
        select location_id, rel_dir, filename, file_size + case when file_id % 13 = 0 then 1 else 0 end as file_size,
          case when file_id % 17 = 0 then modified_at + interval '1' day else modified_at end as modified_at
        from f_line where (stale = 0 and file_id % 11 <> 0) or (stale = 1 and file_id % 62 = 0)
        union all select location_id, rel_dir, concat('new_', filename) as filename, file_size, modified_at from f_line where stale = 0 and file_id % 19 = 0) u""",
    "f_tags": """select distinct file_id, tag from (select file_id, lower(p_type) as tag from f_line join part on p_partkey = pk where file_id % 4 = 0
        union all select file_id, lower(p_brand) as tag from f_line join part on p_partkey = pk where file_id % 4 = 0) u""",
    "f_legacy": "select file_id, concat(' ', p_type, ',', lower(p_type), ' ,,', p_brand, '  X') as tags from f_line join part on p_partkey = pk where file_id % 6 = 0",
    "f_ignore": "select filename, file_size, case when file_id % 2 = 0 then null else location_id end as location_id from f_line where file_id % 97 = 0",
    "f_scans": """select cast(o_orderkey as bigint) as scan_id, cast(o_orderkey % 5 + 1 as bigint) as location_id, case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'failed' end as status,
        cast(o_orderdate as timestamp) as started_at, case when o_orderstatus = 'F' then cast(o_orderdate as timestamp) + interval '1' hour end as completed_at from orders""",
    "f_pending": """select cast(event_id as bigint) as op_id, event_type as op_type, cast(event_id as bigint) as file_id,
        case when event_id % 3 = 0 then 'pending' when event_id % 3 = 1 then 'completed' else 'failed' end as status from events""",
    "f_docs": """select cast(doc_id as bigint) as file_id, lang as rel_dir, concat('doc', doc_id, '.txt') as filename, concat(lang, '/doc', doc_id, '.txt') as rel_path, source as location,
        text as content, cast(OCTETS(text) as bigint) as file_size from documents""",
    "f_rows": """select location_id, rel_path, file_id, case when file_id % 23 = 0 then 'bad' when file_id % 5 = 0 then 'D' when file_id % 7 = 0 then 'H' else 'F' end as kind, rel_dir, file_size, content_fast, inode from f_line""",
    "f_listing_tsv": """select location_id, case kind when 'D' then concat('D', chr(9), rel_dir) when 'bad' then concat('F', chr(9), rel_path, chr(9), 'x')
        when 'H' then concat('H', chr(9), rel_path, chr(9), coalesce(content_fast, '')) else concat('F', chr(9), rel_path, chr(9), file_size, chr(9), '100', chr(9), '200', chr(9), inode) end as value from f_rows
        union all select location_id, concat('H', chr(9), rel_path, chr(9), content_fast) as value from f_rows where kind = 'F' and content_fast is not null and file_id % 2 = 0""",
}

#: Views that Spark derives in another way than the text above says: folders from the different folders of files, not from each file three times.
_SPARK = {
    "f_folders": """select distinct location_id, rel_path from (
        select location_id, explode(array(split_part(rel_dir,'/',1), concat(split_part(rel_dir,'/',1),'/',split_part(rel_dir,'/',2)), rel_dir)) as rel_path
        from (select distinct location_id, rel_dir from f_line) d union all select location_id, 'empty' as rel_path from f_locations) u""",
}
#: Views that most queries use several times, and so written once a query: folders, and the five narrow columns that all
#: columns of files come from, so that lineitem is grouped once and not in each branch of a plan.
_WRITTEN = {"f_folders", "f_base"}


def needed(*names: str) -> list[str]:
    """The named views and those they stand on, in order."""
    import re

    found: set[str] = set()
    todo = list(names)
    while todo:
        if (name := todo.pop()) not in found:
            found.add(name)
            todo += [x for x in CTES if x != name and re.search(rf"\b{x}\b", CTES[name])]
    return [x for x in CTES if x in found]


def spark_views(spark: SparkSession, sf_dir: str, *names: str, once: tuple[str, ...] = ()) -> list[DataFrame]:
    """The named views as DataFrames over the Parquet tables of sf_dir; those in `once`, which a query reads many times, are written, too."""
    import re

    made: dict[str, DataFrame] = {}
    for name in needed(*names):
        text = _SPARK.get(name, CTES[name]).replace("SHA256(", "sha2(").replace("concat(pk,'|',q)) end as hash_strong", "concat(pk,'|',q), 256) end as hash_strong").replace("OCTETS(", "octet_length(")
        used = {x for x in (*_TABLES, *CTES) if x != name and re.search(rf"\b(from|join)\s+{x}\b", text)}
        for x in used & set(_TABLES):
            made.setdefault(x, spark.read.parquet(f"{sf_dir}/{x}.parquet"))
        text = reduce(lambda t, x: re.sub(rf"\b(from|join)\s+{x}\b", rf"\1 {{{x}}} as {x}", t), used, text)
        made[name] = spark.sql(text, **{x: made[x] for x in used})
        if name in _WRITTEN or name in once:
            made[name] = written(made[name])
    return [made[x] for x in names]


def duck_views(*names: str) -> str:
    """A WITH clause that defines the named views for DuckDB."""
    text = {k: v.replace("SHA256(", "sha256(").replace("OCTETS(", "strlen(") for k, v in CTES.items()}
    return "with " + ",\n ".join(f"{x} as ({text[x]})" for x in needed(*names)) + "\n"
