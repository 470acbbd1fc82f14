"""The registered queries over the synthetic tables, and their DuckDB twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, paths, scoring
from ..operators import blocks, classify, delta, images, match
from ..sources import container, headers, pseudo, snapshots, streams
from ..sources.snapshots import Snapshot
from . import api, files
from .scratch import forget, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _documents(spark: SparkSession, sf_dir: str) -> tuple[Snapshot, Snapshot]:
    s, t = snapshots.fixture_pair(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text"))
    return snapshots.of_table(s), snapshots.of_table(t)


def _pages(spark: SparkSession, sf_dir: str) -> tuple[Snapshot, Snapshot]:
    """Addresses may repeat: pages of one address are in the order of their ids."""
    s, t = snapshots.pages_pair(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return snapshots.of_table(s, order="page_id"), snapshots.of_table(t, order="page_id")


_PATH = "concat(source, '/', lang, '/doc-', cast(doc_id as varchar(20)), {version}, '.txt')"
_S = f"select {_PATH.format(version="'.v1'")} as path, text as content from documents where doc_id % 7 <> 3"
_BUMP = "case when doc_id % 5 = 0 then '.v2' else '.v1' end"
_T = f"""select {_PATH.format(version=_BUMP)} as path, case when doc_id % 4 = 1 then concat(text, ' patched') else text end as content
from documents where doc_id % 11 <> 5"""
_PS = "select url as path, html as content from pages where page_id % 7 <> 3"
_PT = "select url as path, case when page_id % 4 = 1 then concat(html, ' patched') else html end as content from pages where page_id % 11 <> 5"


def _manifest(rows: str) -> str:
    return f"""select cast(row_number() over (order by path) - 1 as bigint) as idx, path, content, size,
      cast(coalesce(sum(size) over (order by path rows between unbounded preceding and 1 preceding), 0) as bigint) as off
      from (select path, content, cast(strlen(content) as bigint) as size from ({rows}))"""


_PAIR = f"with s as ({_manifest(_S)}), t as ({_manifest(_T)})"
_SHAPE = "regexp_replace({0}, '[0-9]+', '#', 'g')"
_MATCH = "case when {shape_a} = {shape_b} then 1 + len(list_filter(list_zip(string_split({a}, '/'), string_split({b}, '/')), lambda x: x[1] <> x[2])) else 0 end"


def _fuzzy(a: str, b: str) -> str:
    return _MATCH.format(a=a, b=b, shape_a=_SHAPE.format(a), shape_b=_SHAPE.format(b))


_WITHIN_TWO = "(({0} = 0 and {1} = 0) or ({0} > 0 and {1} > 0 and 2 * least({0}, {1}) >= greatest({0}, {1})))"
_ANCHORED = """, x as (select t.idx as ti, t.path, t.size as t_size, t.content as t_content, s.idx as si from t left join s using (path)),
  anchored as (select *, coalesce(last_value(si ignore nulls) over (order by ti rows between unbounded preceding and 1 preceding), 0) as last from x)"""


@query(f"{_PAIR} select idx, path, size, off from s")
def manifest_source(spark, sf_dir):
    return _documents(spark, sf_dir)[0].entries.select("idx", "path", "size", "off")


@query(f"{_PAIR} select idx, path, size, off from t")
def manifest_target(spark, sf_dir):
    return _documents(spark, sf_dir)[1].entries.select("idx", "path", "size", "off")


@query(f"{_PAIR} select t.idx as ti, path, s.idx as si from t left join s using (path)")
def match_exact(spark, sf_dir):
    s, t = _documents(spark, sf_dir)
    return match.exact(t.entries, s.entries).select(F.col("t_idx").alias("ti"), "path", F.col("s_idx").alias("si"))


@query(f"{_PAIR} select path, max(idx) as idx, arg_max(size, idx) as size from (select idx, path, size from s union all select idx + 1000000, path, size + 1 from s where idx % 3 = 0) group by path")
def match_dedupe_last_wins(spark, sf_dir):
    s = _documents(spark, sf_dir)[0].entries.select("idx", "path", "size")
    again = s.where("idx % 3 = 0").select((F.col("idx") + 1000000).alias("idx"), "path", (F.col("size") + 1).alias("size"))
    return match.last_wins(s.unionByName(again)).select("path", "idx", "size")


_CURSOR = """, m as (select t.idx as ti, path, t.size as tz, s.idx as si, s.size as z, s.off as o, md5(s.content) as hs, md5(t.content) as ht from t left join s using (path)),
  c as (select *, cast(coalesce(max(case when z > 0 then o + z end) over (order by ti rows between unbounded preceding and 1 preceding), 0) as bigint) as cur from m)"""


@query(f"{_PAIR}{_CURSOR} select ti, si, cur as cursor, coalesce(o < cur, false) as behind from c")
def cursor_forward_only(spark, sf_dir):
    s, t = _documents(spark, sf_dir)
    return match.with_cursor(match.exact(t.entries, s.entries)).select(F.col("t_idx").alias("ti"), F.col("s_idx").alias("si"), "cursor", "behind")


@query(
    f"""{_PAIR}{_CURSOR}, e as (select *, case when si is null or o < cur then 0 else z end as eff from c)
    select ti, path, si, coalesce(o < cur, false) as behind,
           case when si is not null and eff = tz and (eff = 0 or hs = ht) then 'identical' when eff = 0 then 'new' else 'modified' end as status from e"""
)
def classify_exact(spark, sf_dir):
    s, t = _documents(spark, sf_dir)
    return classify.forward(t.entries, s.entries)


@query(f"{_PAIR} select idx, path, size from t where not exists (select 1 from s where s.path = t.path)")
def new_entries(spark, sf_dir):
    s, t = _documents(spark, sf_dir)
    return classify.new_entries(t.entries, s.entries)


@query(f"{_PAIR} select idx, path, size from s where not exists (select 1 from t where t.path = s.path)")
def removed_entries(spark, sf_dir):
    s, t = _documents(spark, sf_dir)
    return classify.removed_entries(match.exact(t.entries, s.entries).select(F.col("s_idx").alias("si")), s.entries)


@query(f"select path, {_SHAPE.format('path')} as shape, list_extract(string_split(path, '/'), -1) as name from ({_T})")
def path_normalise(spark, sf_dir):
    t = _documents(spark, sf_dir)[1].entries
    return t.select("path", paths.shape(F.col("path")).alias("shape"), paths.basename(F.col("path")).alias("name"))


@query(f"{_PAIR} select t.idx as ti, t.path as a, s.path as b, cast({_fuzzy('t.path', 's.path')} as integer) as match from t join s using (idx)")
def fuzzy_components(spark, sf_dir):
    s, t = _documents(spark, sf_dir)
    pairs = t.entries.select("idx", F.col("path").alias("a")).join(s.entries.select("idx", F.col("path").alias("b")), "idx")
    return pairs.select(F.col("idx").alias("ti"), "a", "b", paths.fuzzy_match(F.col("a"), F.col("b")).alias("match"))


@query(
    f"""{_PAIR} select t.idx as ti, t.size as a, s.size as b, {_WITHIN_TWO.format("t.size", "s.size")} as within_two, 5 * least(t.size, s.size) >= 4 * greatest(t.size, s.size) as within_fifth,
    cast(case when greatest(t.size, s.size) = 0 then 100 else floor(100 * least(t.size, s.size) / greatest(t.size, s.size)) end as bigint) as percent from t join s using (idx)"""
)
def size_similarity(spark, sf_dir):
    s, t = _documents(spark, sf_dir)
    pairs = t.entries.select("idx", F.col("size").alias("a")).join(s.entries.select("idx", F.col("size").alias("b")), "idx")
    a, b = F.col("a"), F.col("b")
    return pairs.select(F.col("idx").alias("ti"), "a", "b", scoring.sizes_within_two(a, b).alias("within_two"), scoring.sizes_within_fifth(a, b).alias("within_fifth"), scoring.size_percent(a, b).alias("percent"))


_CANDIDATES = f"""{_PAIR}{_ANCHORED}, cand as (
  select ti, anchored.path, s.idx as si, s.path as s_path, t_size, s.size as s_size, s.idx - last as distance, cast({_fuzzy("anchored.path", "s.path")} as integer) as match
  from anchored join s on {_SHAPE.format("anchored.path")} = {_SHAPE.format("s.path")} and {{range}}
  where anchored.si is null)"""


@query(
    f"""{_CANDIDATES.format(range="s.idx > last and s.idx < last + 20")},
    v as (select *, cast(case when {_WITHIN_TWO.format("t_size", "s_size")} then 10 else 0 end + 21 - distance + case when match < 3 then 10 else 0 end as bigint) as score from cand)
    select *, score > 25 as accepted from v"""
)
def fuzzy_candidates_scored(spark, sf_dir):
    s, t = _documents(spark, sf_dir)
    return match.scored(t.entries, s.entries)


_BEST = f"""{_CANDIDATES.format(range="s.idx >= last - 20 and s.idx < last + 20")},
  ranked as (select *, row_number() over (partition by ti order by match, abs(t_size - s_size), abs(distance), si) as n from cand
    where s_path not in (select path from t) and (5 * least(t_size, s_size) >= 4 * greatest(t_size, s_size) or match <= 2)),
  best as (select x.ti, x.path, case when x.si is not null then 'exact' when r.si is not null then 'fuzzy' else 'none' end as kind, coalesce(x.si, r.si) as si
    from x left join ranked r on r.ti = x.ti and r.n = 1),
  planned as (select b.ti, b.path, kind, t.size as t_size, s.size as s_size, s.path as s_path, b.si,
    case when b.si is not null and s.size = t.size and (s.size = 0 or md5(s.content) = md5(t.content)) then 'identical' when b.si is null or s.size = 0 then 'new' else 'modified' end as status
    from best b join t on t.idx = b.ti left join s on s.idx = b.si)"""


@query(f"{_BEST} select ti, path, kind, si from best")
def fuzzy_best(spark, sf_dir):
    s, t = _documents(spark, sf_dir)
    return match.best(t.entries, s.entries)


_RECURSIVE = f"""{_PAIR.replace("with", "with recursive", 1)},
  tt as materialized (select t.idx, t.path, t.size, s.idx as xi, {_SHAPE.format("t.path")} as shape from t left join s using (path)),
  ss as materialized (select idx, path, size, off, {_SHAPE.format("path")} as shape from s),
  cand as materialized (select tt.idx as ti, ss.idx as si, {_WITHIN_TWO.format("tt.size", "ss.size")} as ok, {_fuzzy("tt.path", "ss.path")} as fm from tt join ss using (shape) where xi is null),
  walk as (
    select cast(-1 as bigint) as ti, cast(null as bigint) as si, cast(0 as bigint) as last, cast(0 as bigint) as cur, false as behind, cast(0 as bigint) as eff, 'none' as kind
    union all
    select nti, nsi, coalesce(nsi, last),
           case when nsi is not null and ss.off >= cur and ss.size > 0 then ss.off + ss.size else cur end,
           coalesce(ss.off < cur, false), case when nsi is null or ss.off < cur then 0 else ss.size end,
           case when nsi is null then 'none' when xi is not null then 'exact' else 'fuzzy' end
    from (select tt.idx as nti, xi, w.last, w.cur,
                 coalesce(xi, (select min(c.si) from cand c where c.ti = tt.idx and c.si > w.last and c.si < w.last + 20
                               and (case when ok then 10 else 0 end) + 21 + w.last - c.si + (case when fm < 3 then 10 else 0 end) > 25)) as nsi
          from walk w join tt on tt.idx = w.ti + 1) n left join ss on ss.idx = n.nsi)"""


@query(f"{_RECURSIVE} select walk.ti, tt.path, kind, si, behind, eff from walk join tt on tt.idx = walk.ti")
def match_compat(spark, sf_dir):
    s, t = _documents(spark, sf_dir)
    return match.compat(t.entries, s.entries)


_SUMMARY = "count(*) as entries, cast(sum(t_size) as bigint) as target_bytes, cast(sum(case when status = 'identical' then 8 else 24 end) as bigint) as record_bytes"


@query(f"{_BEST} select status, {_SUMMARY} from planned group by status")
def delta_summary(spark, sf_dir):
    s, t = _documents(spark, sf_dir)
    return classify.summary(classify.plan(t, s))


@query(
    f"""{_RECURSIVE}, p as (select t.size as t_size, case when not behind and si is not null and eff = t.size and (eff = 0 or md5(s.content) = md5(t.content)) then 'identical' when eff = 0 then 'new' else 'modified' end as status
    from walk join t on t.idx = walk.ti left join s on s.idx = walk.si) select status, {_SUMMARY} from p group by status"""
)
def delta_summary_compat(spark, sf_dir):
    s, t = _documents(spark, sf_dir)
    return classify.summary(classify.plan(t, s, "compat"))


@query(f"{_BEST} select status, count(*) as entries, cast(sum(t_size) as bigint) as target_bytes, cast(sum(case when status = 'identical' then 8 else 24 + t_size end) as bigint) as record_bytes from planned group by status")
def delta_summary_store(spark, sf_dir):
    """The delta's size with its real patches; stored ones are as long as their target, so that SQL knows them."""
    s, t = _documents(spark, sf_dir)
    return classify.summary(delta.generate(s, t, "store"), F.col("patch_size"))


@query(f"{_BEST} select cast(sum(case when status = 'identical' then t_size else 0 end) as bigint) as saved_bytes, cast(sum(t_size) as bigint) as target_bytes, count(*) filter (status = 'identical') * 8 as identical_records from planned")
def delta_size_identical_bytes(spark, sf_dir):
    s, t = _documents(spark, sf_dir)
    same = F.col("status") == "identical"
    return classify.plan(t, s).agg(F.sum(F.when(same, F.col("t_size")).otherwise(0)).alias("saved_bytes"), F.sum("t_size").alias("target_bytes"), (F.count_if(same) * 8).alias("identical_records"))


@query(f"{_BEST} select string_split(path, '/')[1] as directory, status, count(*) as entries, cast(sum(t_size) as bigint) as target_bytes from planned group by rollup (directory, status)")
def summary_rollup(spark, sf_dir):
    s, t = _documents(spark, sf_dir)
    return classify.summary_rollup(classify.plan(t, s))


@query(
    f"""{_PAIR} select 'common' as kind, path from (select path from t intersect select path from s)
    union all select 'new', path from (select path from t except select path from s) union all select 'removed', path from (select path from s except select path from t)"""
)
def set_new_common_removed(spark, sf_dir):
    s, t = _documents(spark, sf_dir)
    return classify.sets(t.entries, s.entries)


@query(f"with recursive s as ({_manifest(_PS)}), t as ({_manifest(_PT)}){_BEST.split(_manifest(_T) + ')', 1)[1]} select ti, path, kind, status, si from planned")
def pages_diff(spark, sf_dir):
    """Every pair of pages with one address, as the join of its twin; a delta takes the last source page alone."""
    s, t = _pages(spark, sf_dir)
    return classify.plan(t, s, every=True).select("ti", "path", "kind", "status", F.coalesce("si", F.lit(None)).alias("si"))


def _round_trip(spark, sf_dir, name: str, mode: str = "best") -> DataFrame:
    s, t = _documents(spark, sf_dir)
    return delta.apply(delta.generate(s, t, name, mode), s, name).select("idx", "path", F.octet_length("content").cast("bigint").alias("size"), F.md5("content").alias("md5"))


_TARGET = f"{_PAIR} select idx, path, size, md5(content) as md5 from t"


@query(_TARGET)
def roundtrip_zstd(spark, sf_dir):
    return _round_trip(spark, sf_dir, "zstd")


@query(_TARGET)
def roundtrip_zstd_compat(spark, sf_dir):
    return _round_trip(spark, sf_dir, "zstd", "compat")


@query(_TARGET)
def apply_reconstruct(spark, sf_dir):
    return _round_trip(spark, sf_dir, "store")


def _modified(spark, sf_dir) -> DataFrame:
    """(ti, path, source, target) of entries in both snapshots whose contents differ."""
    s, t = _documents(spark, sf_dir)
    changed = match.exact(t.entries, s.entries).where("s_sha <> t_sha").select(F.col("t_idx").alias("ti"), "path", "s_sha", "t_sha")
    before = snapshots.contents(changed, s.payload, "ti", "path", "s_sha", "source")
    return snapshots.contents(before, t.payload, "ti", "path", "t_sha", "target").select("ti", "path", "source", "target")


@query(f"{_PAIR} select t.idx as ti, path, t.size as size, md5(t.content) as md5 from t join s using (path) where s.content <> t.content")
def roundtrip_block(spark, sf_dir):
    pairs = _modified(spark, sf_dir)
    joined = pairs.select("ti", "path", "source").join(blocks.encode(pairs.select("ti", "source", "target")), "ti")
    made = joined.select("ti", "path", blocks.decode(F.col("source"), F.col("ops")).alias("content"))
    return made.select("ti", "path", F.octet_length("content").cast("bigint").alias("size"), F.md5("content").alias("md5"))


_BLOCKS = "select ti, unnest(range(0, cast(ceil(octet_length({0}) / 64.0) as bigint))) as n, {0} as body from pair"


@query(
    f"""{_PAIR}, pair as (select t.idx as ti, encode(s.content) as src, encode(t.content) as tgt from t join s using (path) where s.content <> t.content),
    sb as (select ti, substr(hex(body), cast(n * 128 + 1 as bigint), 128) as b, n from ({_BLOCKS.format("src")})),
    tb as (select ti, substr(hex(body), cast(n * 128 + 1 as bigint), 128) as b, n from ({_BLOCKS.format("tgt")})),
    firsts as (select ti, b, min(n) as n from sb group by ti, b)
    select tb.ti, count(*) as blocks, count(firsts.n) as copied, cast(coalesce(sum(case when firsts.n is null then length(b) / 2 end), 0) as bigint) as inserted_bytes
    from tb left join firsts using (ti, b) group by tb.ti"""
)
def block_delta_ops(spark, sf_dir):
    return blocks.summary(_modified(spark, sf_dir).select("ti", "source", "target"))


@query(
    f"""{_PAIR}, damaged as (select idx, path, case when idx % 10 = 1 then 'missing' when idx % 10 = 2 then 'size' when idx % 10 = 3 and size > 0 then 'content' when idx % 10 = 5 then 'repeated' end as problem from t
      union all select idx + 1000000, path, 'extra' from t where idx % 10 = 4) select idx, path, problem from damaged where problem is not null"""
)
def verify_mismatches(spark, sf_dir):
    """What the check finds in a rebuilt target of which a half is missing, changed, repeated or moved away."""
    s, t = _documents(spark, sf_dir)
    made, ten = delta.apply(delta.generate(s, t), s), F.col("idx") % 10
    changed = F.when(ten == 2, F.concat("content", F.lit(b"x"))).when((ten == 3) & (F.octet_length("content") > 0), F.concat(F.lit(b"\0"), F.expr("substring(content, 2)"))).otherwise(F.col("content"))
    times = F.when(ten == 1, F.array().cast("array<int>")).when(ten == 4, F.array(F.lit(0), F.lit(1000000))).when(ten == 5, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
    damaged = made.select("idx", "path", changed.alias("content"), F.explode(times).alias("far")).select((F.col("idx") + F.col("far")).alias("idx"), "path", "content")
    return delta.verify(damaged, t.entries)


# --- paths that are there more than once: every third document has a second version, every ninth also a copy ---------

_AGAIN = """select path, content, 0 as version from ({0}) union all
  select path, content || ' again', 1 from ({0}) where cast(regexp_extract(path, 'doc-([0-9]+)', 1) as bigint) % 3 = 0 union all
  select path, content, 2 from ({0}) where cast(regexp_extract(path, 'doc-([0-9]+)', 1) as bigint) % 9 = 0"""


def _ordered_manifest(rows: str) -> str:
    return _manifest(rows).replace("order by path", "order by path, version").replace("select path, content, cast", "select path, version, content, cast")


_REPEATED = f"with s as ({_ordered_manifest(_AGAIN.format(_S))}), t as ({_ordered_manifest(_AGAIN.format(_T))})"


def _repeated(spark, sf_dir) -> tuple[Snapshot, Snapshot]:
    def again(rows: DataFrame) -> Snapshot:
        n = F.regexp_extract("path", "doc-([0-9]+)", 1).cast("bigint")
        versions = [F.array(*map(F.lit, range(k))) for k in (3, 2, 1)]
        each = rows.select("path", "content", F.explode(F.when(n % 9 == 0, versions[0]).when(n % 3 == 0, versions[1]).otherwise(versions[2])).alias("version"))
        content = F.when(F.col("version") == 1, F.concat("content", F.lit(" again"))).otherwise(F.col("content"))
        return snapshots.of_table(each.select("path", content.alias("content"), "version"), order="version")

    s, t = snapshots.fixture_pair(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text"))
    return again(s), again(t)


@query(f"{_REPEATED} select t.idx as ti, path, l.si from t left join (select path, max(idx) as si from s group by path) l using (path)")
def match_repeated_paths(spark, sf_dir):
    """Of source entries with one path the last counts, and every target entry is matched."""
    s, t = _repeated(spark, sf_dir)
    return match.exact(t.entries, s.entries).select(F.col("t_idx").alias("ti"), "path", F.col("s_idx").alias("si"))


@query(f"{_REPEATED} select idx, path, size, md5(content) as md5 from t")
def roundtrip_repeated_paths(spark, sf_dir):
    s, t = _repeated(spark, sf_dir)
    return delta.apply(delta.generate(s, t), s).select("idx", "path", F.octet_length("content").cast("bigint").alias("size"), F.md5("content").alias("md5"))


# --- files: the derived pair as pseudo-files in the shared folder, and deltas between them ---------------------------


def _files(spark, sf_dir, names: tuple[str, ...] = ("source", "target")) -> tuple[str, ...]:
    """The paths of the two pseudo-files, or of those named, and one for a delta."""
    folder = f"{shared_dir(spark).rstrip('/')}/tessera-files-{uuid.uuid4().hex}"
    streams.make_folder(folder)
    forget(spark, folder)
    made = []
    for name, one in zip(("source", "target"), _documents(spark, sf_dir), strict=True):
        if name in names:
            made.append(f"{folder}/{name}")
            pseudo.write_pseudo(snapshots.contents(one.entries.select("idx", "path", "sha"), one.payload, "idx"), made[-1])
    return *made, f"{folder}/delta"


@query(f"{_PAIR} select idx, path, 'R' as type, size, off, md5(content) as md5 from s")
def pseudo_file_scan(spark, sf_dir):
    """The data source of pseudo-files: manifest, segments and contents."""
    source, _ = _files(spark, sf_dir, ("source",))
    return pseudo.read_pseudo(spark, source).select("idx", "path", "type", "size", "off", F.md5("content").alias("md5"))


_MANIFEST_BYTES = "cast((select sum(strlen(path || ' R 0 644 0 0 ' || size || ' ' || off) + 1) from s) + strlen('#') + 1 + strlen('# START OF DATA - DO NOT MODIFY') + 1 + 2 as bigint)"


@query(
    f"""{_RECURSIVE}, p as (select walk.ti, s.idx as si, s.off as o, t.size as tz, md5(t.content) as md5,
      case when not behind and si is not null and eff = t.size and (eff = 0 or md5(s.content) = md5(t.content)) then 'identical' when eff = 0 then 'new' else 'modified' end as status, eff
      from walk join t on t.idx = walk.ti left join s on s.idx = walk.si)
    select ti, case when status = 'identical' then 'identical' else 'patch' end as kind, case when status = 'identical' then si end as si,
      case when status = 'modified' then o + {_MANIFEST_BYTES} when status = 'new' then {_MANIFEST_BYTES} end as src_off,
      case when status = 'modified' then eff when status = 'new' then 0 end as src_size, case when status <> 'identical' then tz end as patch_size, case when status <> 'identical' then md5 end as md5 from p"""
)
def container_scan(spark, sf_dir):
    """The records of a container file, as its data source reads them; the manifest's record apart."""
    source, target, out = _files(spark, sf_dir)
    api.export_container(spark, source, target, out, "store")
    return container.read_container(spark, out).where("ti >= 0").select("ti", "kind", "si", "src_off", "src_size", "patch_size", F.md5("patch").alias("md5"))


def _by_file(spark, sf_dir, name: str) -> DataFrame:
    source, target, out = _files(spark, sf_dir)
    files.generate_file(spark, source, target, out, name)
    files.apply_file(spark, source, out, f"{out}.made")
    return pseudo.read_pseudo(spark, f"{out}.made").select("idx", "path", "size", F.md5("content").alias("md5"))


@query(f"{_PAIR} select idx, path, size, md5(content) as md5 from t")
def container_roundtrip(spark, sf_dir):
    return _by_file(spark, sf_dir, "zstd:3")


@query(f"{_PAIR} select idx, path, size, md5(content) as md5 from t")
def stream_roundtrip(spark, sf_dir):
    return _by_file(spark, sf_dir, "zstd-stream:3")


# --- layouts: the entries are documents of the tables, so that nothing is invented ---------------------------------

_FIELDS = "doc_id as id, 1 + doc_id % 6 as comp, case when doc_id % 2 = 0 then 1 else 2 end as tool, 1700000000 + doc_id as ts, (doc_id * 16) % 1024 as flags"


def _header_rows(spark, sf_dir) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    d = F.col("doc_id")
    return ids.select(d.alias("id"), (1 + d % 6).alias("comp"), F.when(d % 2 == 0, 1).otherwise(2).alias("tool"), (1700000000 + d).alias("ts"), (d * 16 % 1024).alias("flags"))


def _le(value: str, width: int) -> str:
    return " || ".join(f"printf('%02x', (cast({value} as bigint) >> {8 * i}) & 255)" for i in range(width))


@query(f"select id, '7371706601' || '01' || {_le('tool', 2)} || {_le('ts', 4)} || {_le('comp', 2)} || {_le('flags', 2)} || repeat('00', 16) as header from (select {_FIELDS} from documents)")
def header_encode(spark, sf_dir):
    made = headers.header_bytes(F.col("tool"), F.col("ts"), F.col("comp"), F.col("flags"))
    return _header_rows(spark, sf_dir).select("id", F.lower(F.hex(made)).alias("header"))


@query(f"select id, cast(1718645107 as bigint) as magic, 1 as format_v, 1 as tools_v, tool, ts, comp, flags, cast(null as varchar) as error from (select {_FIELDS} from documents)")
def header_decode(spark, sf_dir):
    made = headers.header_bytes(F.col("tool"), F.col("ts"), F.col("comp"), F.col("flags"))
    rows = _header_rows(spark, sf_dir).select("id", made.alias("b"))
    return rows.select("id", headers.decode(F.col("b"), headers.HEADER).alias("h"), headers.header_error(F.col("b")).alias("error")).select("id", "h.*", "error")


@query(
    f"""select id, array_to_string(list_filter([case when flags & 16 <> 0 then '-no-fragments' end, case when flags & 64 = 0 then '-no-duplicates' end,
    case when flags & 128 <> 0 then '-exports' end, case when flags & 512 <> 0 then '-no-xattrs' end], lambda x: x is not null), ' ') as options from (select {_FIELDS} from documents)"""
)
def flags_decode(spark, sf_dir):
    return _header_rows(spark, sf_dir).select("id", F.array_join(codes.rebuild_options(F.col("flags")), " ").alias("options"))


@query(f"select id, list_extract(['gzip', 'lzma', 'lzo', 'xz', 'lz4', 'zstd'], cast(comp as bigint)) as name, case tool when 1 then 'xdelta3' else 'hdiffz' end as tool from (select {_FIELDS} from documents)")
def compression_names(spark, sf_dir):
    return _header_rows(spark, sf_dir).select("id", codes.compression_name(F.col("comp")).alias("name"), codes.tool_name(F.col("tool")).alias("tool"))


@query(
    """select cast(doc_id % 4 as bigint) as format, case doc_id % 4 when 0 then 'xdelta3' when 1 then 'snap-1-1-xdelta3' when 2 then 'snap-1-1-Hdiffz' else 'unexpected' end as label,
    count(*) as entries from documents group by 1, 2"""
)
def store_formats(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") % 4).alias("format"))
    return ids.groupBy("format", codes.store_label(F.col("format")).alias("label")).agg(F.count("*").alias("entries"))


@query(f"select doc_id - 500 as control, case when doc_id - 500 <= 0 then 'identical' else 'patch' end as kind, {_le('doc_id - 500', 8)} as word from documents")
def record_kind(spark, sf_dir):
    from ..functions.binary import le_bytes, le_int64

    control = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") - 500).alias("control"))
    words = control.select(le_bytes(F.col("control"), 8).alias("w"))
    return words.select(le_int64(F.col("w"), 0).alias("control"), container.record_kind(le_int64(F.col("w"), 0)).alias("kind"), F.lower(F.hex("w")).alias("word"))


@query(f"{_PAIR} select idx, path || ' x' as path, size, off from t")
def manifest_parse(spark, sf_dir):
    t = _documents(spark, sf_dir)[1].entries
    named = pseudo.manifest_text(F.concat("path", F.lit(" x")), F.col("size"), F.col("off"))
    noise = F.array(F.struct((F.col("idx") * 4).alias("line_no"), F.lit("# comment").alias("line")), F.struct((F.col("idx") * 4 + 1).alias("line_no"), F.lit("dir D 0 755 0 0").alias("line")), F.struct((F.col("idx") * 4 + 2).alias("line_no"), named.alias("line")), F.struct((F.col("idx") * 4 + 3).alias("line_no"), F.lit("short x").alias("line")))
    return pseudo.parse_lines(t.select(F.inline(noise))).select("idx", "path", "size", "off")


# --- images: a superblock before the text of a document -------------------------------------------------------------

_IMAGE_FLAGS = "case when doc_id % 10 = 0 then 1024 else (doc_id * 16) % 1024 end"
_IMAGE = f"""'68737173' || '00000000' || {_le("1700000000 + doc_id", 4)} || repeat('00', 8) || {_le("1 + doc_id % 6", 2)} || '0000' || {_le(_IMAGE_FLAGS, 2)} || '0000' || '0400' || '0000'"""


def _images(spark, sf_dir, more: str) -> DataFrame:
    from ..functions.binary import le_bytes

    d, zero = F.col("doc_id"), F.lit(0)
    flags = F.when(d % 10 == 0, 1024).otherwise(d * 16 % 1024)
    fields = [(F.lit(0x73717368), 4), (zero, 4), (1700000000 + d, 4), (zero, 8), (1 + d % 6, 2), (zero, 2), (flags, 2), (zero, 2), (F.lit(4), 2), (zero, 2)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    head = F.concat(*[le_bytes(value, width) for value, width in fields])
    return docs.select(d.cast("string").alias("name"), F.concat(head, F.coalesce("text", F.lit("")).cast("binary"), F.lit(more.encode())).alias("content"))


@query(
    f"""select cast(doc_id as varchar) as name, case when doc_id % 10 = 0 then 'plain' else 'container' end as kind,
    case when doc_id % 10 <> 0 then '73717066' end as magic, md5(unhex({_IMAGE} || hex(encode(coalesce(text, '') || ' patched')))) as md5,
    case when doc_id % 10 <> 0 then '-comp ' || list_extract(['gzip', 'lzma', 'lzo', 'xz', 'lz4', 'zstd'], cast(1 + doc_id % 6 as bigint)) || ' ' || array_to_string(list_filter([
      case when (doc_id * 16) & 16 <> 0 then '-no-fragments' end, case when (doc_id * 16) & 64 = 0 then '-no-duplicates' end,
      case when (doc_id * 16) & 128 <> 0 then '-exports' end, case when (doc_id * 16) & 512 <> 0 then '-no-xattrs' end,
      '-mkfs-time ' || (1700000000 + doc_id)], lambda x: x is not null), ' ') end as arguments
    from documents"""
)
def image_roundtrip(spark, sf_dir):
    source = _images(spark, sf_dir, "").where("cast(name as bigint) % 7 <> 3")
    deltas = images.generate(source, _images(spark, sf_dir, " patched"), on_unsupported="plain")
    made = images.apply(deltas, source).select("name", F.md5("content").alias("md5"), F.array_join("arguments", " ").alias("arguments"))
    magic = F.when(F.col("kind") == "container", F.lower(F.hex(F.substring("delta", 1, 4))))
    return deltas.select("name", "kind", magic.alias("magic")).join(made, "name")


@query(f"select cast(doc_id as varchar) as name, md5(unhex({_IMAGE} || hex(encode(coalesce(text, '') || ' patched')))) as md5 from documents where doc_id % 10 <> 0")
def image_apply_by_magic(spark, sf_dir):
    """Deltas that say by their first bytes only what they are."""
    source = _images(spark, sf_dir, "")
    deltas = images.generate(source, _images(spark, sf_dir, " patched").where("cast(name as bigint) % 10 <> 0"))
    return images.apply(deltas.drop("kind"), source).select("name", F.md5("content").alias("md5"))
