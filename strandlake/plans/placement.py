"""Filters, currency, placement and joins."""

SQL = {
    "flt_read_name": """select r.read_id, r.readname, r.status, m.contig_id, m.cstart, m.cfinish, m.direction
        from a_readinfo r left join a_curmap m on m.seq_id=r.read_id
        where r.readname like 't1%.p1k' and (m.contig_id is not null or r.status='PASS')""",
    "flt_contig_property": """select c.contig_id, c.length, c.nreads, c.project_id from a_contig c
        left join a_c2c k on k.contig_id=c.contig_id where k.contig_id is null and c.length between 500 and 2500 and c.nreads>=2""",
    "flt_reads": """select read_id, readname from a_readinfo where asped>=date '1995-01-01' and asped<date '1997-01-01'
        and readname not like '%.q2k' and status='PASS'""",
    "flt_edited_sequences": "select read_id*2+1 as seq_id, read_id, 1 as version from a_read where l_tax>0.04",
    "flt_contigs_with_tags": """select c.contig_id from a_cur c where exists
        (select 1 from a_tag t where t.contig_id=c.contig_id and t.tagtype in ('CLIC','PURC'))""",
    "flt_window_reads": "select contig_id, seq_id, cstart, cfinish from a_map where cfinish>=300 and cstart<=700",
    "flt_project_inventory": "select project_id, name from a_project p where exists (select 1 from a_contig c where c.project_id=p.project_id)",
    "flt_include_exclude": """select c.contig_id, p.name, c.length from a_cur c join a_project p on p.project_id=c.project_id
        where p.name not in ('BIN','FREEASSEMBLY','TRASH') and c.length>1000""",
    "flt_short_reads": "select contig_id, count(*) as nreads from a_map where cfinish-cstart+1>310 group by contig_id",
    "flt_named_reads": """select m.contig_id, count(*) as nreads from a_map m where not exists
        (select 1 from a_readinfo r where r.read_id=m.seq_id and r.status='FAIL') group by m.contig_id""",
    "flt_history_range": """select project_id, created, count(*) as contigs, sum(length) as length from a_contig
        where created>=date '1995-01-01' and created<=date '1996-12-31' group by project_id, created""",
    "flt_transfer_requests": """select request_id, contig_id, requester, status from a_transfer
        where status<>'cancelled' and requester<>owner""",
    "flt_transfer_candidates": """select t.request_id, case when c.contig_id is null then 'not current'
          when c.project_id<>t.old_project_id then 'project changed' else 'active' end as reason
        from a_transfer t left join a_cur c on c.contig_id=t.contig_id where t.status='pending'""",
    "cur_contigs": "select contig_id, project_id, nreads, length from a_cur",
    "cur_contigs_asof": """select distinct c.contig_id, c.length from a_contig c left join a_c2c k on k.parent_id=c.contig_id
        left join a_contig d on d.contig_id=k.contig_id where c.created<date '1997-01-01' and c.nreads>1
        and (k.contig_id is null or d.created>date '1997-01-01')""",
    "free_reads": """select r.read_id, r.readname from a_readinfo r left join a_curmap m on m.seq_id=r.read_id where m.seq_id is null""",
    "free_reads_by_origin": """select l.clone_id, count(*) as free_reads from a_readinfo r
        join a_template t on t.template_id=r.template_id join a_ligation l on l.ligation_id=t.ligation_id
        left join a_curmap m on m.seq_id=r.read_id where m.seq_id is null group by l.clone_id""",
    "free_reads_asof": """select r.read_id from a_readinfo r where not exists (select 1 from a_map m join a_contig c on c.contig_id=m.contig_id
          left join a_c2c k on k.parent_id=c.contig_id left join a_contig d on d.contig_id=k.contig_id
          where m.seq_id=r.read_id and c.created<date '1997-01-01' and c.nreads>1
            and (k.contig_id is null or d.created>date '1997-01-01'))""",
    "read_placement": """select m.contig_id, p.name as project, r.readname, m.cstart, m.cfinish, m.direction
        from a_curmap m join a_readinfo r on r.read_id=m.seq_id join a_project p on p.project_id=m.project_id""",
    "read_current_contig": """select seq_id as read_id, max(contig_id) as contig_id, max_by(project_id, contig_id) as project_id
        from a_curmap group by seq_id""",
    "dup_contig_pairs": """select a.contig_id as contig_a, b.contig_id as contig_b, count(*) as shared from a_curmap a
        join a_curmap b on a.seq_id=b.seq_id and a.contig_id<b.contig_id group by a.contig_id, b.contig_id""",
    "dup_read_allocation": """select a.seq_id, a.contig_id as contig_a, b.contig_id as contig_b,
          case when a.project_id=b.project_id then 'inside' else 'between' end as kind
        from a_curmap a join a_curmap b on a.seq_id=b.seq_id and a.contig_id<b.contig_id""",
    "shared_segments": """select a.contig_id as contig_a, b.contig_id as contig_b, a.seq_id, a.cstart as start_a, a.cfinish as finish_a,
          b.cstart as start_b, b.cfinish as finish_b from a_map a join a_map b on a.seq_id=b.seq_id and a.contig_id<b.contig_id""",
    "contig_family": """select distinct a.contig_id, b.contig_id as relative, case when b.contig_id<a.contig_id then 'ancestor' else 'descendant' end as kind
        from a_map a join a_map b on a.seq_id=b.seq_id and a.contig_id<>b.contig_id""",
    "current_for_ancestor": """select distinct c.contig_id as current_id, b.contig_id as ancestor_id from a_curmap c
        join a_map b on b.seq_id=c.seq_id and b.contig_id<>c.contig_id join a_c2c k on k.parent_id=b.contig_id""",
    "find_parents": """with cand as (select distinct a.contig_id as child, b.contig_id as parent from a_map a
          join a_map b on a.seq_id=b.seq_id and b.contig_id<>a.contig_id join a_contig x on x.contig_id=a.contig_id
          join a_contig y on y.contig_id=b.contig_id where y.created<x.created)
        select child, parent from cand p where not exists (select 1 from cand q join a_c2c k on k.contig_id=q.parent
          where q.child=p.child and k.parent_id=p.parent)""",
    "mate_pairs": """select a.contig_id as contig_a, a.seq_id as seq_a, b.contig_id as contig_b, b.seq_id as seq_b, a.template_id
        from a_place a join a_place b on a.template_id=b.template_id and a.strand<>b.strand and a.contig_id<>b.contig_id""",
    "template_span": """with o as (select contig_id, template_id, strand, cstart, cfinish, sihigh,
            lag(strand) over w as before, lag(cstart) over w as start0 from a_place
          window w as (partition by contig_id, template_id order by cstart, seq_id))
        select contig_id, template_id, cfinish-start0+1-sihigh as excess,
          case when before='Forward' and strand='Reverse' then 'consistent' else 'inconsistent' end as kind from o where before is not null""",
    "overlap_best": """select seq_id, contig_id, other, overlap, kind from (
          select a.contig_id, a.seq_id, b.seq_id as other, least(a.cfinish,b.cfinish)-greatest(a.cstart,b.cstart)+1 as overlap,
            case when b.cstart<=a.cstart and b.cfinish>=a.cfinish then 'C' when b.cstart<a.cstart then 'L' else 'R' end as kind,
            row_number() over (partition by a.contig_id, a.seq_id
              order by least(a.cfinish,b.cfinish)-greatest(a.cstart,b.cstart) desc, b.seq_id) as k
          from a_map a join a_map b on a.contig_id=b.contig_id and a.seq_id<>b.seq_id and b.cstart<=a.cfinish and b.cfinish>=a.cstart) x where k=1""",
    "nearest_interval": """select tag_id, contig_id, seq_id from (select t.tag_id, t.contig_id, m.seq_id,
          row_number() over (partition by t.tag_id order by abs(m.cstart-t.cstart)+abs(m.cfinish-t.cfinal), m.seq_id) as k
          from a_tag t join a_map m on m.contig_id=t.contig_id and m.cstart<=t.cfinal and m.cfinish>=t.cstart) x where k=1""",
    "repeat_partners": """with inside as (select distinct p.contig_id, p.seq_id, p.template_id, p.strand from a_place p join a_tag t on t.contig_id=p.contig_id
            and t.cstart-200<=p.cstart and t.cfinal+400>=p.cfinish)
        select i.contig_id, i.seq_id, q.seq_id as partner, case when q.seq_id is null then 'not found'
          when q.contig_id<>i.contig_id then 'other contig' when r.seq_id is not null then 'in repeat' else 'unique' end as kind
        from inside i left join a_place q on q.template_id=i.template_id and q.strand<>i.strand
        left join inside r on r.seq_id=q.seq_id and r.contig_id=q.contig_id""",
    "missing_names": """select concat('t',cast(o_orderkey*64+1 as varchar(20)),'.p1k') as readname from orders o where not exists
        (select 1 from a_readinfo r where r.readname=concat('t',cast(o.o_orderkey*64+1 as varchar(20)),'.p1k'))""",
    "clip_excess": """select 'left' as side, count(*) as reads, max(qleft-rmin) as most, avg(qleft-rmin) as mean, stddev_pop(qleft-rmin) as sd
          from a_mapping m join a_qualityclip q on q.seq_id=m.seq_id where rmin<qleft
        union all select 'right', count(*), max(rmax-qright), avg(rmax-qright), stddev_pop(rmax-qright)
          from a_mapping m join a_qualityclip q on q.seq_id=m.seq_id where rmax>qright""",
    "end_reads": """select m.contig_id, min(case when m.cstart=f.first then m.seq_id end) as left_read,
          min(case when m.cfinish=c.length then m.seq_id end) as right_read
        from a_map m join a_contig c on c.contig_id=m.contig_id
        join (select contig_id, min(cstart) as first from a_map group by contig_id) f on f.contig_id=m.contig_id group by m.contig_id""",
}
