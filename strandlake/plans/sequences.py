"""Sequence functions, clips, digests, k-mers, consensus."""

_RC = "translate(reverse({0}),'acgtACGT','tgcaTGCA')"

SQL = {
    "fn_revcomp": f"select seq_id, {_RC.format('dna')} as revcomp from a_seq",
    "fn_gc": """select seq_id, case when length(dna)=0 then null else 100-100*cast(length(translate(dna,'gcGC','')) as double)/length(dna) end as gc from a_seq""",
    "fn_end_regions": """select seq_id, case when length(dna)>200 then concat(substr(dna,1,100),repeat('n',cast(length(dna)-200 as int)),
        substr(dna,cast(length(dna)-99 as int),100)) else dna end as ends from a_seq""",
}
