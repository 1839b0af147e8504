"""The tables of an assembly store: their schemas, and scans that check nothing else in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns and types by table.
SCHEMAS = {
    "contig": "contig_id long, gap4name string, length long, ncntgs int, nreads int, newreads int, cover double, origin string, project_id long, creator string, created timestamp, updated timestamp",
    "c2cmapping": "contig_id long, parent_id long, mapping_id long, cstart long, cfinish long, pstart long, pfinish long, direction string, age int",
    "c2csegment": "mapping_id long, cstart long, pstart long, length long",
    "mapping": "contig_id long, seq_id long, mapping_id long, cstart long, cfinish long, direction string",
    "segment": "mapping_id long, cstart long, rstart long, length long",
    "readinfo": "read_id long, readname string, template_id long, asped date, strand string, primer string, chemistry string, basecaller int, status int",
    "seq2read": "seq_id long, read_id long, version int",
    "sequence": "seq_id long, seqlen int, seq_hash binary, qual_hash binary, sequence string, quality array<int>",
    "qualityclip": "seq_id long, qleft int, qright int",
    "seqvec": "seq_id long, svector_id int, svleft int, svright int",
    "clonevec": "seq_id long, cvector_id int, cvleft int, cvright int",
    "template": "template_id long, name string, ligation_id long",
    "ligation": "ligation_id long, name string, clone_id long, silow int, sihigh int",
    "clone": "clone_id long, name string",
    "project": "project_id long, assembly_id long, name string, creator string, owner string, lockowner string, lockdate timestamp, created timestamp, updated timestamp, directory string, status string",
    "assembly": "assembly_id long, name string, chromosome int, origin string, size int, progress string, created timestamp, updated timestamp, creator string",
    "consensus": "contig_id long, sequence string, quality array<int>, length long, updated timestamp",
    "tag2contig": "id long, parent_id long, contig_id long, tag_id long, cstart long, cfinal long, strand string, comment string",
    "contigtag": "tag_id long, tagtype string, systematic_id string, tag_seq_id long, tagcomment string",
    "readtag": "id long, seq_id long, tagtype string, tag_seq_id long, pstart long, pfinal long, strand string, deprecated string, comment string",
    "align2scf": "seq_id long, startinseq int, startinscf int, length int",
    "note": "id long, type string, created timestamp, text string",
    "contigtransferrequest": "request_id long, contig_id long, old_project_id long, new_project_id long, owner string, requester string, opened timestamp, requester_comment string, reviewer string, reviewed timestamp, status string, closed timestamp",
    "importexport": "id long, project_id long, action string, username string, file string, starttime timestamp, endtime timestamp",
    "project_contig_history": "project_id long, statsdate date, name string, total_contigs long, total_reads long, total_contig_length long, mean_contig_length double, stddev_contig_length double, max_contig_length long, n50_contig_length long",
    "organism_history": "organism string, statsdate date, total_reads long, reads_in_contigs long, free_reads long, asped_reads long, next_gen_reads long",
    "scaffold": "scaffold_id long, creator string, created timestamp, import_id long, type_id int, comment string",
    "contigorder": "scaffold_id long, contig_id long, position int, direction string, following_gap_size int",
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of a store that lies as Parquet in a folder per table; columns that the files lack are null."""
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder.rstrip('/')}/{table}")


def write(rows: DataFrame, folder: str, table: str, mode: str = "error") -> None:
    """Rows as a table of a store; columns of the schema that they lack become null, others are refused."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(SCHEMAS[table])
    if extra := set(rows.columns) - set(schema.names):
        raise ValueError(f"{table} has no {', '.join(sorted(extra))}")
    rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)).write.mode(mode).parquet(f"{folder.rstrip('/')}/{table}")
