"""Aggregations, histories, window-shaped operators, sorts and set operations."""


SQL = {
    "project_summary": """with r as (select project_id, length, nreads, created,
            sum(length) over (partition by project_id order by length desc, contig_id) as run,
            sum(length) over (partition by project_id) as total from a_cur where length>=0 and nreads>=1)
        select project_id, count(*) as contigs, cast(sum(nreads) as bigint) as nreads, cast(sum(length) as bigint) as total_length,
          cast(round(avg(length)) as bigint) as mean_length, cast(round(stddev_pop(length)) as bigint) as sd_length,
          max(length) as max_length, max(created) as newest,
          cast(coalesce(max(case when run>floor(total/2.0) then length end),0) as bigint) as n50 from r group by project_id""",
    "contig_stats_month": """select year(created) as yr, month(created) as mon, count(*) as contigs, cast(sum(nreads) as bigint) as nreads,
        cast(sum(length) as bigint) as total_length from a_cur group by year(created), month(created)""",
    "n50": """select project_id, cast(coalesce(max(case when run>floor(total/2.0) then length end),0) as bigint) as n50 from
        (select project_id, length, sum(length) over (partition by project_id order by length desc, contig_id) as run,
           sum(length) over (partition by project_id) as total from a_cur) x group by project_id""",
    "dup_reads": "select seq_id, count(*) as hits from a_curmap group by seq_id having count(*)>1",
    "dup_reads_detail": """select m.seq_id, m.contig_id, m.cstart, m.cfinish from a_curmap m
        join (select seq_id from a_curmap group by seq_id having count(*)>1) d on d.seq_id=m.seq_id""",
    "mapping_extent": "select contig_id, seq_id, rmin, rmax from a_mapping",
    "coverage_depth": """with e as (select contig_id, cstart as pos, 1 as d from a_map union all select contig_id, cfinish+1, -1 from a_map),
          s as (select contig_id, pos, sum(d) as d from e group by contig_id, pos),
          r as (select contig_id, pos, cast(sum(d) over (partition by contig_id order by pos) as bigint) as depth,
                  lead(pos) over (partition by contig_id order by pos) as next_pos from s)
        select contig_id, pos as first_base, next_pos-1 as last_base, depth from r where next_pos is not null""",
    "reads_by_month": "select year(asped) as yr, month(asped) as mon, count(*) as reads from a_readinfo where status='PASS' and asped is not null group by year(asped), month(asped)",
    "template_strand_counts": """select template_id, cast(sum(case when strand='Forward' then 1 else 0 end) as bigint) as forward_reads,
        cast(sum(case when strand='Reverse' then 1 else 0 end) as bigint) as reverse_reads from a_readinfo group by template_id""",
    "transfer_counts": """select cast(opened as date) as day, new_project_id as project_id, count(*) as n from a_transfer
        where status='done' and requester=owner group by cast(opened as date), new_project_id""",
    "last_transfer_out": "select old_project_id as project_id, max(opened) as closed from a_transfer where status='done' group by old_project_id",
    "import_export_latest": """select project_id, action, max(starttime) as last_start, max(endtime) as last_end from a_importexport group by project_id, action""",
    "contig_checksum": """select contig_id, md5(JOINED[cast(seq_id as varchar(20)); ','; seq_id]) as checksum from a_map group by contig_id""",
    "directories": "select distinct p.name as directory from a_project p join a_contig c on c.project_id=p.project_id",
    "total_length": "select project_id, cast(sum(length) as bigint) as total_length from a_cur group by project_id",
    "contig_holes": """select contig_id, seq_id, cstart, reach from (select contig_id, seq_id, cstart,
          max(cfinish) over (partition by contig_id order by cstart, seq_id rows between unbounded preceding and 1 preceding) as reach from a_map) x
        where cstart>reach""",
    "contig_islands": """with r as (select contig_id, seq_id, cstart, cfinish,
            max(cfinish) over (partition by contig_id order by cstart, seq_id rows between unbounded preceding and 1 preceding) as reach from a_map),
          i as (select *, sum(case when reach is not null and cstart>reach then 1 else 0 end) over (partition by contig_id order by cstart, seq_id
            rows between unbounded preceding and current row) as island from r)
        select contig_id, cast(island as bigint) as island, count(*) as nreads, min(cstart) as first_base, max(cfinish) as last_base from i group by contig_id, island""",
    "low_quality_pads": """select seq_id, pos, base, q from (select seq_id, pos, base, q,
          lag(q,2) over (partition by seq_id order by pos) as q1, lead(q,2) over (partition by seq_id order by pos) as q2 from a_base_at) x
        where base not in ('a','c','g','t','n') or (q1 is not null and q2 is not null and q<(q1+q2)/2.0-15 and q<15)""",
    "segment_collate": """with g as (select contig_id, seq_id, direction, cstart, rstart, length,
            lag(cstart+length) over w as cend, lag(case when direction='Forward' then rstart+length else rstart-length end) over w as rend
          from a_segment window w as (partition by contig_id, seq_id order by cstart)),
          i as (select *, sum(case when cend is null or cstart-cend<>case when direction='Forward' then rstart-rend else rend-rstart end or cstart-cend>2
              then 1 else 0 end) over (partition by contig_id, seq_id order by cstart rows between unbounded preceding and current row) as part from g)
        select contig_id, seq_id, cast(part as bigint) as part, min(cstart) as cstart, max(cstart+length)-min(cstart) as length from i group by contig_id, seq_id, part""",
    "dedupe_tags": """with g as (select contig_id, tagtype, tag_id, cstart, cfinal, max(cfinal) over (partition by contig_id, tagtype order by cstart, tag_id
            rows between unbounded preceding and 1 preceding) as reach from a_tag),
          i as (select *, sum(case when reach is null or cstart>reach then 1 else 0 end) over (partition by contig_id, tagtype order by cstart, tag_id
            rows between unbounded preceding and current row) as part from g)
        select contig_id, tagtype, min(cstart) as cstart, max(cfinal) as cfinal, count(*) as tags from i group by contig_id, tagtype, part""",
    "top_contigs": "select contig_id, length from a_cur where length>1000 order by length desc, contig_id limit 100",
    "latest_note": "select project_id, max_by(id, id) as latest from a_importexport where action='import' group by project_id",
    "last_added_contig": """select project_id, contig_id from (select project_id, contig_id,
        row_number() over (partition by project_id order by created desc, contig_id desc) as k from a_contig) x where k=1""",
    "last_change": """select project_id, max(t) as changed from (select project_id, cast(created as timestamp) as t from a_cur
          union all select project_id, cast(endtime as timestamp) from a_importexport where action='import' and endtime is not null
          union all select new_project_id, cast(opened as timestamp) from a_transfer where status='done'
          union all select old_project_id, cast(opened as timestamp) from a_transfer where status='done') x group by project_id""",
    "export_pending": """with c as (select project_id, max(cast(created as timestamp)) as t from a_cur group by project_id),
          e as (select project_id, max(cast(endtime as timestamp)) as t from a_importexport where action='export' group by project_id)
        select c.project_id, e.t is null or c.t>e.t as pending from c left join e on e.project_id=c.project_id""",
    "initial_contigs": "select c.contig_id from a_contig c where not exists (select 1 from a_c2c k where k.contig_id=c.contig_id)",
    "not_reassigned": """select t.contig_id, 'locked' as reason from a_transfer t join a_contig c on c.contig_id=t.contig_id where t.new_project_id<3
        union select t.contig_id, 'missing project' from a_transfer t where not exists (select 1 from a_project p where p.project_id=t.new_project_id+3)""",
    "read_with_template": "select r.read_id, r.readname, t.ligation_id from a_readinfo r left join a_template t on t.template_id=r.template_id",
}
