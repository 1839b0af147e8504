"""Interval mapping algebra, scaffolding, lineage, tags and integrity rules."""

_SEG = """s as (select contig_id, seq_id, cstart as x0, cstart+length-1 as x1, case when direction='Forward' then 1 else -1 end as dir,
      case when direction='Forward' then rstart else rstart-length+1 end as y0,
      case when direction='Forward' then rstart+length-1 else rstart end as y1 from a_segment)"""
_HOOK = """h as (select contig_id, contig_length, seq_id, template_id, strand, direction, cstart, cfinish, project_id, 'R' as side,
        cstart+sihigh-contig_length as overhang from a_place where direction='Forward' and cstart>contig_length-8000
          and cstart+sihigh-contig_length>=1 and sihigh<=8000
      union all select contig_id, contig_length, seq_id, template_id, strand, direction, cstart, cfinish, project_id, 'L', sihigh-cfinish
        from a_place where direction='Reverse' and cfinish<8000 and sihigh-cfinish>=1 and sihigh<=8000)"""
_LINKS = _HOOK + """, bl as (select h.contig_id as one, m.contig_id as other, h.template_id,
        2*(case when h.side='L' then 1 else 0 end)+(case when m.direction='Forward' then 1 else 0 end) as endcode,
        case when m.direction='Forward' then h.overhang-(m.contig_length-m.cstart) else h.overhang-m.cfinish end as gap
      from h join a_place m on m.template_id=h.template_id and m.strand<>h.strand and m.contig_id<>h.contig_id)"""
_BRIDGES = _LINKS + """, br as (select least(one,other) as a, greatest(one,other) as b,
        case when one<other then endcode when endcode=0 then 3 when endcode=3 then 0 else endcode end as endcode,
        count(distinct template_id) as templates, min(gap) as gap_min, max(gap) as gap_max from bl where gap>0
      group by least(one,other), greatest(one,other), case when one<other then endcode when endcode=0 then 3 when endcode=3 then 0 else endcode end)"""

_RC = "translate(reverse({0}),'acgtACGT','tgcaTGCA')"

SQL = {
    "map_shift": f"with {_SEG} select contig_id, seq_id, x0+1000 as x0, x1+1000 as x1, y0, y1, dir from s",
    "map_mirror": f"with {_SEG} select s.contig_id, s.seq_id, c.length+1-s.x1 as x0, c.length+1-s.x0 as x1, s.y0, s.y1, -s.dir as dir from s join a_contig c on c.contig_id=s.contig_id",
    "map_inverse": f"with {_SEG} select contig_id, seq_id, y0 as x0, y1 as x1, x0 as y0, x1 as y1, dir from s",
    "map_transform": f"""with {_SEG} select contig_id, seq_id, dir, case when dir=1 then y0+greatest(x0,300)-x0 else y1-(least(x1,600)-x0) end as y_first,
          case when dir=1 then y0+least(x1,600)-x0 else y1-(greatest(x0,300)-x0) end as y_last from s where x0<=600 and x1>=300""",
    "map_split": f"with {_SEG} select contig_id, seq_id, row_number() over (partition by contig_id, seq_id order by x0) as part, x0, x1, y0, y1 from s",
    "map_extents": "select contig_id, min(cstart) as cmin, max(cfinish) as cmax, min(rmin) as rmin, max(rmax) as rmax from a_mapping group by contig_id",
    "end_hooks": f"with {_HOOK} select contig_id, seq_id, template_id, side, overhang from h",
    "bridge_links": f"with {_LINKS} select one, other, template_id, endcode, gap from bl where gap>0",
    "bridges": f"with {_BRIDGES} select a, b, endcode, templates, gap_min, gap_max from br",
    "template_bridges": f"with {_HOOK} select template_id, count(distinct contig_id) as contigs from h group by template_id having count(distinct contig_id)>1",
    "best_bridge": f"""with {_BRIDGES}, ends as (select a as contig_id, endcode, b as other, templates, gap_min from br union all
          select b, case endcode when 0 then 3 when 3 then 0 else endcode end, a, templates, gap_min from br)
        select contig_id, side, other, templates, gap_min from (select contig_id, cast(floor(endcode/2.0) as int) as side, other, templates, gap_min,
          row_number() over (partition by contig_id, cast(floor(endcode/2.0) as int) order by templates desc, gap_min, other, endcode) as k from ends where templates>=2) x where k=1""",
    "lineage_edges": "select contig_id, parent_id from a_c2c where parent_id<>0",
    "lineage_age": """with recursive walk(contig_id, relative, gen) as (select c.contig_id, c.contig_id, 0 from a_cur c
          union all select w.contig_id, k.parent_id, w.gen+1 from walk w join a_c2c k on k.contig_id=w.relative)
        select relative as contig_id, max(gen) as age from walk group by relative""",
    "single_read_parents": """select k.contig_id, k.parent_id from a_c2c k join a_contig p on p.contig_id=k.parent_id join a_contig c on c.contig_id=k.contig_id
        where p.nreads=1 and c.nreads>1""",
    "chk_duplicate_reads": "select seq_id, count(distinct contig_id) as contigs from a_curmap group by seq_id having count(distinct contig_id)>1",
    "chk_shared_reads": "select a.contig_id as contig_a, b.contig_id as contig_b, count(*) as n from a_curmap a join a_curmap b on a.seq_id=b.seq_id and a.contig_id<b.contig_id group by a.contig_id, b.contig_id",
    "chk_cleanup_preview": "select s.contig_id, s.seq_id, count(*) as segments from a_segment s left join a_cur c on c.contig_id=s.contig_id where c.contig_id is null group by s.contig_id, s.seq_id",
    "map_compare": f"""with {_SEG} select k.contig_id, k.parent_id, c.seq_id, c.dir*p.dir as align,
          case when c.dir=p.dir then (c.x0-c.dir*(case when c.dir=1 then c.y0 else -c.y1 end))-(p.x0-p.dir*(case when p.dir=1 then p.y0 else -p.y1 end)) else c.x0+p.x1 end as shift,
          min(greatest(c.y0,p.y0)) as y_first, max(least(c.y1,p.y1)) as y_last, count(*) as pieces
        from a_c2c k join s c on c.contig_id=k.contig_id join s p on p.contig_id=k.parent_id and p.seq_id=c.seq_id and p.y0<=c.y1 and p.y1>=c.y0
        group by 1,2,3,4,5""",
    "map_transform_string": f"""with {_SEG}, d as (select s.contig_id, s.seq_id, s.x0, s.x1, lag(s.x1) over (partition by s.contig_id, s.seq_id order by s.x0) as last,
          case when s.dir=1 then substr(q.dna,cast(s.y0 as int),cast(s.y1-s.y0+1 as int)) else {_RC.format("substr(q.dna,cast(s.y0 as int),cast(s.y1-s.y0+1 as int))")} end as piece
          from s join a_readseq q on q.seq_id=s.seq_id)
        select contig_id, seq_id, JOINED[concat(repeat('-',cast(greatest(coalesce(x0-last-1,0),0) as int)),piece); ''; x0] as carried from d group by contig_id, seq_id""",
}
