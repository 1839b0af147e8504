"""Queries that call the operators of ``functions`` with arguments, and DuckDB SQL written apart for those that the older SQL doesn't state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import lineage as li
from strandlake.functions import mappings as mp
from strandlake.functions import selections as se
from strandlake.functions import statistics as st
from strandlake.plans.assembly import Assembly
from strandlake.streaming.increments import increment

CALLS: dict[str, Callable[[Assembly], DataFrame]] = {}
DUCK: dict[str, str] = {}


def call(name: str, oracle: str | None = None):
    def keep(query: Callable[[Assembly], DataFrame]):
        CALLS[name] = query
        if oracle:
            DUCK[name] = oracle
        return query

    return keep


def day(name: str) -> Column:
    return F.col(name).cast("date")


# ---- selections

call("flt_read_name")(lambda a: se.find_reads(a.readinfo, a.curmap, "t1*.p1k").select("read_id", "readname", "status", "contig_id", "cstart", "cfinish", "direction"))
call("flt_contig_property")(lambda a: se.contigs_by_property(a.contig, a.c2c, "initial", length=(500, 2500), nreads=(2, None)).select("contig_id", "length", "nreads", "project_id"))
call("flt_reads")(lambda a: se.select_reads(a.readinfo, "1995-01-01", "1997-01-01", unlike="%.q2k").select("read_id", "readname"))
call("flt_edited_sequences")(lambda a: se.edited_sequences(a.version).select("seq_id", "read_id", "version"))
call("flt_contigs_with_tags")(lambda a: se.contigs_with_tags(a.cur, a.tag, ["CLIC", "PURC"]).select("contig_id"))
call("flt_window_reads")(lambda a: se.window_reads(a.map, 300, 700).select("contig_id", "seq_id", "cstart", "cfinish"))
call("flt_project_inventory")(lambda a: se.project_inventory(a.project, a.contig).select("project_id", "name"))
call("flt_include_exclude")(lambda a: se.in_projects(a.cur, a.project, exclude=["BIN", "FREEASSEMBLY", "TRASH"], longer=1000).select("contig_id", "name", "length"))
call("flt_short_reads")(lambda a: se.counted_again(se.without_short(a.map, 310)))
_NAMES = "select read_id, concat(readname, case cast(floor(read_id/64.0) as bigint)%4 when 0 then '.a-1' when 1 then '.' else '' end) as readname from a_readinfo"
call("flt_invalid_names", f"select * from ({_NAMES}) n where not (contains(readname, 'p1k.a-1') or contains(readname, 'p2k.a-1') or contains(readname, 'q1k.a-1') or contains(readname, 'q2k.a-1'))")(
    lambda a: se.valid_names(a.sql(_NAMES)))
call("flt_named_reads")(lambda a: se.counted_again(se.without_reads(a.map, se.select_reads(a.readinfo, status="FAIL"))))
call("flt_deprecated_tags", "select tag_id, contig_id, tagtype from (select *, case when tag_id%4=0 then 'Y' else 'N' end as deprecated from a_tag) t where deprecated='N'")(
    lambda a: a.tag.withColumn("deprecated", F.when(F.col("tag_id") % 4 == 0, "Y").otherwise("N")).where("deprecated = 'N'").select("tag_id", "contig_id", "tagtype"))
call("flt_history_range")(lambda a: se.history_range(a.contig, "created", "1995-01-01", "1996-12-31").groupBy("project_id", "created").agg(F.count("*").alias("contigs"), F.sum("length").alias("length")))
call("flt_transfer_requests")(lambda a: se.transfer_requests(a.transfer).select("request_id", "contig_id", "requester", "status"))
_ASKED = """select request_id, contig_id, old_project_id, status from a_transfer union all
    select request_id+100000000, contig_id, old_project_id, case when status='done' then 'approved' else 'pending' end from a_transfer where requester=0"""
call("flt_transfer_candidates", f"""with q as ({_ASKED}) select request_id, case when c.contig_id is null then 'not current'
        when exists (select 1 from q e where e.contig_id=q.contig_id and e.request_id<q.request_id and e.status in ('pending','approved')) then 'already requested'
        when c.project_id<>old_project_id then 'project changed' else 'active' end as reason from q left join a_cur c on c.contig_id=q.contig_id where status='pending'""")(
    lambda a: se.transfer_candidates(a.sql(_ASKED), a.cur))


@call("ext_procedures", """select 'find reads by name' as procedure, count(*) as n from a_readinfo r left join a_curmap m on m.seq_id=r.read_id
        where r.readname like 't2%' and (m.contig_id is not null or r.status='PASS')
      union all select 'free reads by name', count(*) from a_readinfo r where r.readname like '%q1k%' and r.status='PASS'
        and not exists (select 1 from a_curmap m where m.seq_id=r.read_id)
      union all select 'project summary by name', count(*) from a_cur c join a_project p on p.project_id=c.project_id where p.name='FRANCE' and c.length>=1000 and c.nreads>=2
      union all select 'contig holes', count(*) from (select contig_id, cstart, max(cfinish) over (partition by contig_id order by cstart, seq_id
          rows between unbounded preceding and 1 preceding) as reach from a_map) x where cstart>reach
      union all select 'delete singletons', count(*) from a_map m join a_contig c on c.contig_id=m.contig_id where not (c.nreads=1
        and not exists (select 1 from a_c2c k where k.parent_id=c.contig_id))""")
def procedures(a: Assembly) -> DataFrame:
    """What the stored procedures do, as functions with arguments; here the number of rows of each."""
    from pyspark.sql import Window as W

    reach = F.max("cfinish").over(W.partitionBy("contig_id").orderBy("cstart", "seq_id").rowsBetween(W.unboundedPreceding, -1))
    free = a.readinfo.join(a.curmap.select(F.col("seq_id").alias("read_id")), "read_id", "left_anti")
    gone = li.doomed(a.contig, a.c2c, "singleton")
    each = {
        "find reads by name": se.find_reads(a.readinfo, a.curmap, "t2*"),
        "free reads by name": se.select_reads(free, like="%q1k%"),
        "project summary by name": se.in_projects(a.cur, a.project, ["FRANCE"], longer=999).where("nreads >= 2"),
        "contig holes": a.map.withColumn("reach", reach).where("cstart > reach"),
        "delete singletons": li.pruned({"mapping": a.map}, gone)["mapping"],
    }
    out = None
    for name, rows in each.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("procedure"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# ---- lineage

_LINKS = """l as (select k.contig_id, k.parent_id, c.seq_id, case when c.direction=p.direction then 1 else -1 end as dir,
      case when c.direction=p.direction then c.cstart-p.cstart else c.cstart+p.cfinish end as shift, c.cstart, c.cfinish
      from a_c2c k join a_map c on c.contig_id=k.contig_id join a_map p on p.contig_id=k.parent_id and p.seq_id=c.seq_id),
    best as (select contig_id, parent_id, arg_max(dir, b*10+dir) as dir from (select contig_id, parent_id, dir, sum(cfinish-cstart+1) as b from l group by all) x group by all),
    kept as (select l.* from l join best using (contig_id, parent_id, dir)),
    lines as (select *, max(cfinish) over (partition by contig_id, parent_id, shift order by cstart, seq_id rows between unbounded preceding and 1 preceding) as reach from kept),
    numbered as (select *, sum(case when reach is null or cstart>reach then 1 else 0 end) over (partition by contig_id, parent_id, shift order by cstart, seq_id) as part from lines),
    parts as (select contig_id, parent_id, dir, shift, part, count(*) as nreads, min(cstart) as cstart, max(cfinish) as cfinish from numbered group by all),
    links as (select contig_id, parent_id, dir, shift, cast(part as bigint) as part, nreads, cstart, cfinish from
      (select *, 1+cast(floor(ln(sum(nreads) over (partition by contig_id, parent_id))) as int) as least from parts) x where nreads>=least)"""
#: Links as the lineage tables hold them: those of one read or more.
_ALL = _LINKS.replace("where nreads>=least", "")


def linked(a: Assembly, least_reads: int | None = 1) -> DataFrame:
    return li.link_contigs(a.map, a.c2c, least_reads=least_reads)


call("find_parents")(lambda a: li.found_parents(a.map, a.contig, a.c2c))
call("lineage_edges")(lambda a: a.c2c.where("parent_id <> 0").select("contig_id", "parent_id"))
_WALK = """with recursive walk(contig_id, relative, gen) as (select contig_id, parent_id, 1 from a_c2c
          union all select w.contig_id, k.parent_id, w.gen+1 from walk w join a_c2c k on k.contig_id=w.relative)"""
call("lineage_relations", _WALK + """ select contig_id, relative, min(gen) as gen_min, max(gen) as gen_max from walk group by contig_id, relative
    union all select relative, contig_id, -max(gen), -min(gen) from walk group by contig_id, relative""")(lambda a: li.both_ways(li.relations(a.c2c)))
call("lineage_age")(lambda a: li.ages(a.cur, a.c2c))
call("contigs_at_age", """with recursive walk(contig_id, relative, gen) as (select c.contig_id, c.contig_id, 0 from a_cur c
          union all select w.contig_id, k.parent_id, w.gen+1 from walk w join a_c2c k on k.contig_id=w.relative)
        select relative as contig_id from walk group by relative having max(gen)=2""")(lambda a: li.at_age(a.cur, a.c2c, 2))
call("link_contigs", f"with {_LINKS} select * from links")(lambda a: linked(a, None))


@call("link_valid", f"""with {_ALL}, n as (select contig_id, parent_id, sum(nreads) as shared, max(cfinish)-min(cstart)+1 as overlap from links group by all),
        x as (select n.*, c.nreads as cn, p.nreads as pn, p.length as pl, case when p.nreads<=2 then 1 else sqrt(p.nreads-0.4::double)+0.1::double end as base
          from n join a_contig c on c.contig_id=n.contig_id join a_contig p on p.contig_id=n.parent_id)
        select contig_id, parent_id, cast(shared as bigint) as shared, cast(overlap as bigint) as overlap, case when shared=pn or shared=cn then 1 when shared<base then 0
          when base<=1 and overlap*2<greatest(pl,1) then 0 when shared<pn-base then 2 else 1 end as verdict from x""")
def link_valid(a: Assembly) -> DataFrame:
    sums = linked(a).groupBy("contig_id", "parent_id").agg(F.sum("nreads").alias("shared"), (F.max("cfinish") - F.min("cstart") + 1).cast("long").alias("overlap"))
    return li.valid_links(sums, a.contig)


call("link_repair", """with c as (select distinct x.contig_id, y.contig_id as parent_id from a_map x join a_map y on x.seq_id=y.seq_id and x.contig_id<>y.contig_id
          join a_contig p on p.contig_id=x.contig_id join a_contig q on q.contig_id=y.contig_id where q.created<p.created),
        f as (select * from c where not exists (select 1 from c d join a_c2c k on k.contig_id=d.parent_id where d.contig_id=c.contig_id and k.parent_id=c.parent_id))
      select coalesce(s.contig_id,f.contig_id) as contig_id, coalesce(s.parent_id,f.parent_id) as parent_id,
        case when s.contig_id is null then 'missing' when f.contig_id is null then 'invalid' else 'confirmed' end as state
      from (select distinct contig_id, parent_id from a_c2c) s full outer join f on f.contig_id=s.contig_id and f.parent_id=s.parent_id""")(
    lambda a: li.repaired(a.c2c, li.found_parents(a.map, a.contig, a.c2c).withColumnsRenamed({"child": "contig_id", "parent": "parent_id"})))
call("contig_checksum")(lambda a: li.contig_checksums(a.map))


def incoming(a: Assembly) -> DataFrame:
    """Mappings of contigs to be imported: the newer half of every project's contigs again, every third moved by 100."""
    return a.sql("""select m.contig_id+100000000 as contig_id, m.seq_id, m.direction, m.cstart+case when m.contig_id%3=0 then 100 else 0 end+case when m.contig_id%5=0 then m.seq_id%2 else 0 end as cstart,
        m.cfinish+case when m.contig_id%3=0 then 100 else 0 end as cfinish from a_map m join a_contig c on c.contig_id=m.contig_id where c.created>=date '1996-01-01'""")


_INCOMING = """inc as (select m.contig_id+100000000 as contig_id, m.seq_id, m.direction, m.cstart+case when m.contig_id%3=0 then 100 else 0 end+case when m.contig_id%5=0 then m.seq_id%2 else 0 end as cstart,
        m.cfinish+case when m.contig_id%3=0 then 100 else 0 end as cfinish from a_map m join a_contig c on c.contig_id=m.contig_id where c.created>=date '1996-01-01')"""
_SHAPE = "select contig_id, string_agg(seq_id||direction||(cstart-z)||':'||(cfinish-z), ',' order by seq_id, direction, cstart) as shape from (select *, min(cstart) over (partition by contig_id) as z from {0}) x group by contig_id"
call("contig_dedupe", f"with {_INCOMING}, a as ({_SHAPE.format('inc')}), b as ({_SHAPE.format('a_map')}) select a.contig_id, min(b.contig_id) as same_as from a join b on a.shape=b.shape group by a.contig_id")(
    lambda a: li.already_stored(incoming(a), a.map.select("contig_id", "seq_id", "direction", "cstart", "cfinish")))
call("contig_load", f"""with {_INCOMING}, a as ({_SHAPE.format('inc')}), b as ({_SHAPE.format('a_map')}), same as (select a.contig_id, min(b.contig_id) as same_as from a join b on a.shape=b.shape group by a.contig_id),
      size as (select contig_id, count(*) as nreads, max(cfinish)-min(cstart)+1 as length, md5(string_agg(cast(seq_id as varchar), ',' order by seq_id)) as checksum from inc group by contig_id),
      now as (select contig_id, project_id from a_contig c where not exists (select 1 from a_c2c k where k.parent_id=c.contig_id)),
      sh as (select i.contig_id, m.contig_id as parent_id, n.project_id, count(*) as k from inc i join a_map m on m.seq_id=i.seq_id join now n on n.contig_id=m.contig_id group by all),
      par as (select contig_id, string_agg(cast(parent_id as varchar), ',' order by parent_id) as parents, first(project_id order by k desc, parent_id) as project_id from sh group by contig_id)
      select s.contig_id, case when same_as is null then 'loaded' else 'duplicate' end as outcome, same_as, nreads, length, checksum, coalesce(parents,'') as parents, cast(coalesce(project_id,0) as bigint) as project_id
      from size s left join same using (contig_id) left join par using (contig_id)""")(lambda a: li.load(incoming(a), a.map.select("contig_id", "seq_id", "direction", "cstart", "cfinish"), a.contig, a.c2c, 0))


@call("retire_prune", """with gone as (select contig_id from a_contig c where (nreads=1 or nreads=0 or length<500) and not exists (select 1 from a_c2c k where k.parent_id=c.contig_id)
          union select contig_id from a_contig where created>date '1998-06-01' union select contig_id from a_contig where project_id=2)
        select 'contig' as name, count(*) as n from a_contig where contig_id not in (select contig_id from gone)
        union all select 'mapping', count(*) from a_map where contig_id not in (select contig_id from gone)
        union all select 'segment', count(*) from a_segment where contig_id not in (select contig_id from gone)
        union all select 'lineage', count(*) from a_c2c where contig_id not in (select contig_id from gone) and parent_id not in (select contig_id from gone)
        union all select 'tag', count(*) from a_tag where contig_id not in (select contig_id from gone)""")
def retire(a: Assembly) -> DataFrame:
    """Rows of each table that stay when singletons, orphans, short contigs, those after a date and those of project 2 go."""
    rules = [("singleton", {}), ("orphaned", {}), ("short", {"length": 500}), ("after", {"date": "1998-06-01"}), ("project", {"project_id": 2})]
    gone = None
    for rule, options in rules:
        one = li.doomed(a.contig, a.c2c, rule, **options)
        gone = one if gone is None else gone.unionByName(one)
    tables = {"contig": a.contig, "mapping": a.map, "segment": a.segment, "lineage": a.c2c, "tag": a.tag}
    out = None
    for name, rows in li.pruned(tables, gone.distinct()).items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


call("assign_contigs", """select t.contig_id, case when outcome='moved' then pid else old end as project_id, outcome from (select t.contig_id, c.project_id as old, p.project_id as pid,
        case when c.contig_id is null then 'unknown contig' when p.project_id is null then 'unknown project' when r.contig_id is null then 'not current' else 'moved' end as outcome
      from (select contig_id, new_project_id+requester as new_project_id from a_transfer) t left join a_contig c on c.contig_id=t.contig_id left join a_project p on p.project_id=t.new_project_id
      left join a_cur r on r.contig_id=t.contig_id) t""")(
    lambda a: li.assigned(a.transfer.select("contig_id", (F.col("new_project_id") + F.col("requester")).alias("new_project_id")), a.contig, a.cur, a.project))

call("assign_audit", """select t.contig_id, c.project_id as from_project, p.project_id as to_project, t.requester, t.opened from a_transfer t join a_contig c on c.contig_id=t.contig_id
      join a_cur r on r.contig_id=t.contig_id join a_project p on p.project_id=t.new_project_id+t.requester where p.project_id<>c.project_id""")(
    lambda a: li.audit_rows(a.transfer.select("contig_id", (F.col("new_project_id") + F.col("requester")).alias("new_project_id"), "requester", "opened"), a.contig, a.cur, a.project))

#: The parents' reads of every third contig lie up to 120 places off.
_UNRULY = """select contig_id, seq_id, direction, cstart+d as cstart, cfinish+d as cfinish from (select *, case when contig_id%3=0 then (seq_id*37)%11*12 else 0 end as d from a_map) x"""
call("link_unruly", f"""with moved as ({_UNRULY}), {_LINKS.replace('a_map', 'moved').replace('where nreads>=least', 'where nreads>=1')},
      w as (select *, cfinish-cstart+1 as size, max(cfinish-cstart+1) over (partition by contig_id, parent_id, shift) as big, count(*) over (partition by contig_id, parent_id, shift) as many from parts),
      e as (select contig_id, parent_id, shift, count(*) as n, avg((cstart+cfinish)/2.0::double) as place, sum(((cstart+cfinish)/2.0::double)^2) as pp, sum((cstart+cfinish)/2.0::double*shift) as ps, sum(shift::double^2) as ss
        from w where many=1 or size>case when big<=5 then big/2.0 else 5 end group by all),
      t as (select *, place-lag(place) over v as step from e window v as (partition by contig_id, parent_id order by shift)),
      u as (select *, case when step*lag(step) over (partition by contig_id, parent_id order by shift)<0 then 1 else 0 end as turn from t),
      bad as (select contig_id, parent_id from u group by all having max(shift)-min(shift)>=20 and abs(sum(ps)/sqrt(sum(pp)*sum(ss)))<0.9 and sum(n-1+turn)>0),
      b as (select contig_id, parent_id, shift, sum(cfinish-cstart+1) as b from kept group by all),
      r as (select *, sum(b) over (partition by contig_id, parent_id order by shift) as run, sum(b) over (partition by contig_id, parent_id) as every from b),
      mid as (select contig_id, parent_id, min(shift) as middle from r semi join bad using (contig_id, parent_id) where run*2>=every group by all),
      f as (select p.*, middle, middle is not null and abs(shift-middle)*2>20 as far from parts p left join mid using (contig_id, parent_id) where middle is null or cfinish>cstart),
      g as (select contig_id, parent_id, min(cstart) as s, max(cfinish) as f from f where far group by all),
      h as (select f.*, g.s, g.f, row_number() over (partition by contig_id, parent_id order by cstart, cfinish desc, shift) as k from f left join g using (contig_id, parent_id) where not far),
      i as (select * from h where k=1 or s is null or cstart<s or cfinish>f),
      j as (select * from i x where not exists (select 1 from i y where y.contig_id=x.contig_id and y.parent_id=x.parent_id and (y.shift<>x.shift or y.part<>x.part) and y.cstart<=x.cstart and y.cfinish>=x.cfinish
          and (y.cstart<x.cstart or y.cfinish>x.cfinish or (y.shift, y.part)<(x.shift, x.part)))),
      l2 as (select *, (greatest(0, cfinish+1-lead(cstart) over (partition by contig_id, parent_id order by cstart))+1)//2 as give from j)
      select contig_id, parent_id, dir, shift, cast(part as bigint) as part, nreads, cstart+coalesce(lag(give) over (partition by contig_id, parent_id order by cstart),0) as cstart, cfinish-give as cfinish
      from l2 qualify cstart+coalesce(lag(give) over (partition by contig_id, parent_id order by cstart),0)<=cfinish-give""")(
    lambda a: li.link_contigs(a.sql(_UNRULY), a.c2c, least_reads=1, window=20, correlation=0.9, defects=0, prune=True))

# ---- statistics

call("project_summary")(lambda a: st.project_summary(a.once("cur")))
call("n50")(lambda a: st.n50(a.cur, "project_id"))
call("contig_stats_tiers", """with t as (select unnest([0,500,1000,2000,5000]) as tier) select t.tier, c.project_id, count(*) as contigs, cast(sum(c.nreads) as bigint) as nreads, cast(sum(c.length) as bigint) as total_length,
          cast(round(avg(c.length)) as bigint) as mean_length, max(c.length) as max_length from a_cur c join t on c.length>=t.tier where c.nreads>2 group by t.tier, c.project_id""")(
    lambda a: st.tiers(a.cur, (0, 500, 1000, 2000, 5000)))
call("project_report_total", """with c as (select c.*, p.name from a_cur c join a_project p on p.project_id=c.project_id where p.name not in ('BIN','FREEASSEMBLY','TRASH')),
        e as (select name, length, nreads, contig_id from c union all select 'TOTAL', length, nreads, contig_id from c),
        r as (select *, sum(length) over (partition by name order by length desc, contig_id) as run, sum(length) over (partition by name) as total from e)
        select name, count(*) as contigs, cast(sum(nreads) as bigint) as nreads, cast(sum(length) as bigint) as total_length, max(length) as max_length,
          cast(coalesce(max(case when run>floor(total/2.0) then length end),0) as bigint) as n50 from r group by name""")(lambda a: st.report(a.once("cur"), a.project))
call("contig_statistics", """with m as (select *, cfinish-cstart+1 as span from a_map)
        select contig_id, min(cstart) as first_base, max(cfinish) as last_base, max(cfinish)-min(cstart)+1 as length,
          cast(floor((sum(span)*200.0+(max(cfinish)-min(cstart)+1))/(2.0*(max(cfinish)-min(cstart)+1))) as double)/100 as cover, 1-min(cstart) as zero_shift,
          first(seq_id order by cstart, span, seq_id) as left_read, first(seq_id order by cfinish desc, span, seq_id) as right_read from m group by contig_id""")(lambda a: st.contig_statistics(a.map))
call("base_quality_histogram", """select seq_id, base, count(*) as n, round(avg(q),6) as mean, round(sqrt(avg(q*q)),6) as rms,
        round(count(*) filter (where base=' ')/cast(nullif(count(*) filter (where base<>' '),0) as double),6) as pad_rate from a_base_at group by rollup(seq_id, base)""")(
    lambda a: st.base_qualities(a.base_at).select("seq_id", "base", "n", *(F.round(c, 6).alias(c) for c in ("mean", "rms", "pad_rate"))))
_GONE = """c as (select c.contig_id, c.project_id, cast(c.created as date) as created, c.length, c.nreads, max(cast(d.created as date)) as gone
    from a_contig c left join a_c2c k on k.parent_id=c.contig_id left join a_contig d on d.contig_id=k.contig_id group by all),
  days as (select cast(unnest(generate_series(date_trunc('{0}', (select min(created) from c)), date_trunc('{0}', (select max(created) from c)), interval '{1}')) as date) as day),
  live as (select d.day, c.* from days d join c on c.created<d.day and (c.gone is null or c.gone>d.day) and c.nreads>1)"""
_MONTH, _WEEK, _DAY = _GONE.format("month", "1 month"), _GONE.format("week", "7 days"), _GONE.format("day", "1 day")
_TOTALS = """count(*) as contigs, cast(sum(nreads) as bigint) as nreads, cast(sum(length) as bigint) as total_length, cast(round(avg(length)) as bigint) as mean_length,
          cast(round(stddev_pop(length)) as bigint) as sd_length, max(length) as max_length"""


def dated(a: Assembly) -> DataFrame:
    return a.once("contig").withColumn("created", day("created"))


call("project_history", f"""with {_MONTH}, r as (select *, sum(length) over (partition by day, project_id order by length desc, contig_id) as run, sum(length) over (partition by day, project_id) as total from live)
        select day, project_id, {_TOTALS}, cast(coalesce(max(case when run>floor(total/2.0) then length end),0) as bigint) as n50 from r group by day, project_id""")(lambda a: st.project_history(dated(a), a.c2c))
call("weekly_monthly_series", f"with {_MONTH} select day, 'month' as step, {_TOTALS} from live group by day union all select * from (with {_WEEK} select day, 'week' as step, {_TOTALS} from live group by day) w")(
    lambda a: st.series(dated(a), a.c2c).select("day", "step", "contigs", "nreads", "total_length", "mean_length", "sd_length", "max_length"))
_READS_BY_DAY = """with c as (select c.contig_id, cast(c.created as date) as created, c.nreads, max(cast(d.created as date)) as gone
    from a_contig c left join a_c2c k on k.parent_id=c.contig_id left join a_contig d on d.contig_id=k.contig_id group by all),
  days as (select cast(unnest(generate_series(date_trunc('week', (select min(created) from c)), date_trunc('week', (select max(created) from c)), interval '7 days')) as date) as day),
  placed as (select d.day, count(distinct m.seq_id) as in_contigs from days d join c on c.created<d.day and (c.gone is null or c.gone>d.day) and c.nreads>1 join a_map m on m.contig_id=c.contig_id group by d.day)
  select p.day, cast(p.in_contigs as bigint) as in_contigs, t.total, t.total-p.in_contigs as free_reads, t.asped, t.total-t.asped as next_gen from placed p, (select count(*) as total, count(asped) as asped from a_readinfo) t"""
call("organism_history", _READS_BY_DAY)(lambda a: st.organism_history(dated(a), a.c2c, a.map, a.readinfo, "week"))
_FREE = _READS_BY_DAY.replace("date_trunc('week'", "date_trunc('day'").replace("'7 days'", "'1 day'")
call("history_delta", f"with h as ({_FREE}) select a.day, a.free_reads-b.free_reads as delta from h a join h b on b.day=cast(a.day - interval '1 day' as date) where abs(a.free_reads-b.free_reads)>20")(
    lambda a: st.history_delta(st.organism_history(dated(a), a.c2c, a.map, a.readinfo), "free_reads", 20))
_INHERIT = """select contig_id, '{0}' as measure, project_id from (select k.contig_id, p.project_id, row_number() over (partition by k.contig_id order by {1} desc, p.project_id) as r
      from a_c2c k join a_contig p on p.contig_id=k.parent_id group by k.contig_id, p.project_id) x where r=1"""


@call("project_inheritance", " union all ".join(_INHERIT.format(n, m) for n, m in (("reads", "sum(p.nreads)"), ("length", "sum(p.length)"), ("contigs", "count(*)"), ("largest", "max(p.length)"), ("average", "max(p.length)/count(*)"))))
def project_inheritance(a: Assembly) -> DataFrame:
    contigs, out = a.once("contig"), None
    for measure in st.MEASURES:
        one = st.inherited_project(a.c2c, contigs, measure).withColumn("measure", F.lit(measure))
        out = one if out is None else out.unionByName(one)
    return out


call("read_batches", """with recursive d as (select asped, count(*) as n, row_number() over (order by asped) as k from a_readinfo where asped is not null group by asped),
        go(k, asped, n, run, batch) as (select k, asped, n, n, 0 from d where k=1 union all select d.k, d.asped, d.n, case when go.run>500 then 0 else go.run end+d.n, go.batch+case when go.run>500 then 1 else 0 end from go join d on d.k=go.k+1)
        select asped, n, cast(batch as bigint) as batch from go""")(lambda a: st.read_batches(a.readinfo, 500))
call("sort_contigs", "select contig_id, project_id, length from a_cur order by project_id, length desc, contig_id")(lambda a: st.sorted_contigs(a.cur, "length", by_project=True).select("contig_id", "project_id", "length"))
call("sort_projects", """select p.project_id, p.name, coalesce(c.contigs,0) as contigs from a_project p left join (select project_id, count(*) as contigs from a_cur group by project_id) c on c.project_id=p.project_id order by contigs desc, name""")(
    lambda a: st.sorted_projects(a.project, a.once("cur")).select("project_id", "name", "contigs"))
call("organism_activity", """select p.assembly_id, max(c.created) as last_contig, count(*) as contigs, cast(sum(c.nreads) as bigint) as nreads, cast(sum(c.length) as bigint) as total_length, coalesce(max(i.n),0) as recent_imports
        from a_contig c join a_project p on p.project_id=c.project_id left join (select q.assembly_id, count(*) as n from a_importexport x join a_project q on q.project_id=x.project_id
          where x.action='import' and x.starttime>=(select max(starttime) from a_importexport) - interval '7 days' group by q.assembly_id) i on i.assembly_id=p.assembly_id group by p.assembly_id""")(
    lambda a: activity(a, 7))


def activity(a: Assembly, days: int) -> DataFrame:
    """Per assembly: newest contig, totals, and the imports of the last days before the newest record."""
    of = a.project.select("project_id", "assembly_id")
    last = a.importexport.agg(F.max("starttime").alias("last"))
    recent = a.importexport.where("action = 'import'").join(F.broadcast(last)).where(F.col("starttime") >= F.col("last") - F.make_dt_interval(F.lit(days)))
    imports = recent.join(of, "project_id").groupBy("assembly_id").agg(F.count("*").alias("recent_imports"))
    sums = a.contig.join(of, "project_id").groupBy("assembly_id").agg(F.max("created").alias("last_contig"), F.count("*").alias("contigs"), F.sum("nreads").cast("long").alias("nreads"), F.sum("length").cast("long").alias("total_length"))
    return sums.join(imports, "assembly_id", "left").na.fill(0, ["recent_imports"])


call("read_increment", """with held as (select * from a_readinfo where template_id*4<(select max(template_id)*3 from a_readinfo))
        select read_id, readname from a_readinfo where read_id>(select max(read_id) from held) and readname not in (select readname from held)""")(
    lambda a: increment(a.readinfo, a.sql("select * from a_readinfo where template_id*4<(select max(template_id)*3 from a_readinfo)")).select("read_id", "readname"))

# ---- interval mappings

_X = "contig_id, seq_id, x0, x1, y0, y1, dir"
call("map_normalise", "select contig_id, seq_id, min(dir) as dir, min(x0) as x0, max(x1) as x1, min(y0) as y0, max(y1) as y1, count(*) as segments, 'regular' as reason from a_seg group by contig_id, seq_id")(
    lambda a: mp.normalised(mp.from_ends(a.seg.select("contig_id", "seq_id", F.when(F.col("x0") % 2 == 0, F.col("x0")).otherwise(F.col("x1")).alias("x_first"), F.when(F.col("x0") % 2 == 0, F.col("x1")).otherwise(F.col("x0")).alias("x_last"),
                                      F.when((F.col("x0") % 2 == 0) == (F.col("dir") == 1), F.col("y0")).otherwise(F.col("y1")).alias("y_first"), F.when((F.col("x0") % 2 == 0) == (F.col("dir") == 1), F.col("y1")).otherwise(F.col("y0")).alias("y_last")))))
call("map_regular", """with t as (select t.*, row_number() over (partition by contig_id, seq_id order by x0, x1, y0) as k from (select contig_id, seq_id, x0-case when seq_id%7=0 then x0%200 else 0 end as x0, x1, y0, y1,
          case when seq_id%11=0 and y0%2=0 then -dir else dir end as dir from a_seg) t),
        f as (select t.contig_id, t.seq_id, case when p.dir<>t.dir then 3 when t.x0<=p.x1 then 2 when (t.dir=1 and t.y0<=p.y1) or (t.dir<>1 and t.y1>=p.y0) then 1 else 0 end as f from t left join t p on p.contig_id=t.contig_id and p.seq_id=t.seq_id and p.k=t.k-1)
        select contig_id, seq_id, case max(f) when 3 then 'mixed directions' when 2 then 'x overlaps' when 1 then 'y out of order' else 'regular' end as reason from f group by contig_id, seq_id""")(
    lambda a: mp.regular(a.sql("select contig_id, seq_id, x0-case when seq_id%7=0 then x0%200 else 0 end as x0, x1, y0, y1, case when seq_id%11=0 and y0%2=0 then -dir else dir end as dir from a_seg")))
call("map_shift")(lambda a: mp.shifted(a.seg, 1000))
call("map_mirror")(lambda a: mp.mirrored(a.seg.join(a.contig.select("contig_id", "length"), "contig_id"), F.col("length") + 1).drop("length"))
call("map_inverse")(lambda a: mp.inverse(a.seg))
call("map_multiply", """select r.contig_id, t.contig_id as contig_2, r.seq_id, r.dir*t.dir as dir,
          case when r.dir=1 then r.x0+greatest(r.y0,t.y0)-r.y0 else r.x0+r.y1-least(r.y1,t.y1) end as x0,
          case when r.dir=1 then r.x0+least(r.y1,t.y1)-r.y0 else r.x0+r.y1-greatest(r.y0,t.y0) end as x1,
          case when t.dir=1 then t.x0+greatest(r.y0,t.y0)-t.y0 else t.x0+t.y1-least(r.y1,t.y1) end as y0,
          case when t.dir=1 then t.x0+least(r.y1,t.y1)-t.y0 else t.x0+t.y1-greatest(r.y0,t.y0) end as y1
        from a_seg r join a_seg t on r.seq_id=t.seq_id and r.contig_id<>t.contig_id and r.y0<=t.y1 and t.y0<=r.y1""")(lambda a: mp.multiplied(a.once("seg"), a.once("seg")).where("contig_id <> contig_2"))
call("map_transform")(lambda a: mp.transformed(a.seg, 300, 600))
call("map_join", """with s as (select *, x0-case when dir=1 then y0 else -y1 end as shift from a_seg), r as (select *, lag(x1) over (partition by contig_id, seq_id, dir, shift order by x0) as reach from s),
        i as (select *, sum(case when reach is null or x0>reach+1 then 1 else 0 end) over (partition by contig_id, seq_id, dir, shift order by x0) as part from r)
        select contig_id, seq_id, dir, shift, min(x0) as x0, max(x1) as x1, min(y0) as y0, max(y1) as y1, count(*) as parts from i group by contig_id, seq_id, dir, shift, part""")(lambda a: mp.joined(a.seg))
call("map_extend", """with s as (select s.*, c.length, row_number() over w as k, count(*) over (partition by s.contig_id, s.seq_id) as n from a_seg s join a_contig c on c.contig_id=s.contig_id window w as (partition by s.contig_id, s.seq_id order by x0)),
        e as (select *, case when k=1 then x0-1 else 0 end as a, case when k=n then length-x1 else 0 end as b from s)
        select contig_id, seq_id, x0-a as x0, x1+b as x1, y0-case when dir=1 then a else b end as y0, y1+case when dir=1 then b else a end as y1, dir from e""")(
    lambda a: mp.extended(a.seg.join(a.contig.select("contig_id", "length"), "contig_id"), 1, F.col("length")).drop("length"))
_LIFT = "select 'contig' as side, t.tag_id as id, s.contig_id, s.seq_id, case when s.dir=1 then s.y0+t.cstart-s.x0 else s.y1-(t.cstart-s.x0) end as at from a_tag t join a_seg s on s.contig_id=t.contig_id and t.cstart between s.x0 and s.x1"
call("map_lift", _LIFT + " union all select 'read', q.seq_id, s.contig_id, s.seq_id, case when s.dir=1 then s.x0+q.qleft-s.y0 else s.x1-(q.qleft-s.y0) end from a_qualityclip q join a_seg s on s.seq_id=q.seq_id and q.qleft between s.y0 and s.y1")(
    lambda a: mp.lifted(a.seg, a.tag.select(F.col("tag_id").alias("id"), "contig_id", F.col("cstart").alias("pos"))).select(F.lit("contig").alias("side"), "id", "contig_id", "seq_id", F.col("y").alias("at")).unionByName(
        mp.lifted(mp.inverse(a.seg), a.qualityclip.select(F.col("seq_id").alias("id"), "seq_id", F.col("qleft").alias("pos")), "seq_id").select(F.lit("read").alias("side"), "id", "contig_id", "seq_id", F.col("y").alias("at"))))
call("map_equal", """with z as (select *, min(x0) over (partition by contig_id, seq_id) as lo, max(x1) over (partition by contig_id, seq_id) as hi from a_seg),
        p as (select contig_id, seq_id, lo, hi, string_agg((x0-lo)||','||(x1-x0)||','||y0||','||dir, ';' order by x0) as plain, string_agg((hi-x1)||','||(x1-x0)||','||y0||','||(-dir), ';' order by x1 desc) as turned from z group by all)
        select a.contig_id, a.seq_id, b.contig_id as contig_id_2, b.seq_id as seq_id_2, case when a.plain=b.plain then 1 else -1 end as aligned, case when a.plain=b.plain then b.lo-a.lo else b.hi+a.lo end as shift
        from p a join p b on a.seq_id=b.seq_id and a.contig_id<b.contig_id and (a.plain=b.plain or a.plain=b.turned)""")(lambda a: mp.equal(a.seg, a.seg).where("contig_id < contig_id_2"))
_EDITS = """select read_id as seq_id, 1 as x0, 150 as x1, 3 as y0, 152 as y1, 1 as dir from a_read union all select read_id, 151+read_id%2, 300, 153+read_id%2+read_id%3, 302+read_id%3, 1 from a_read where l_tax>0.04"""
call("map_trace", f"""with e as ({_EDITS}), many as (select seq_id, count(*)>1 as edited from e group by seq_id)
        select s.contig_id, s.seq_id, s.dir, edited, case when s.dir=1 then s.x0+greatest(s.y0,e.x0)-s.y0 else s.x1-(least(s.y1,e.x1)-s.y0) end as x0, case when s.dir=1 then s.x0+least(s.y1,e.x1)-s.y0 else s.x1-(greatest(s.y0,e.x0)-s.y0) end as x1,
          e.y0+greatest(s.y0,e.x0)-e.x0 as y0, e.y0+least(s.y1,e.x1)-e.x0 as y1
        from a_seg s join e on e.seq_id=s.seq_id and s.y0<=e.x1 and e.x0<=s.y1 join many on many.seq_id=s.seq_id""")(lambda a: mp.traced(a.seg, a.sql(_EDITS)))
