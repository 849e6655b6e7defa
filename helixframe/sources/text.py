"""Readers and writers of sequence, interval and model files, each a DataFrame on one side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.seq import sequence_id, wrap80
from helixframe.operators.chunks import chunk_records, fetch_windows  # noqa: F401

CANDIDATE_TSV = "chrom string, start long, end long, consensus string, strand string, score int, score_fwd int, score_bwd int, cons_fwd int, cons_bwd int, cons_len int, gate_left int, gate_right int, gc double"
SUBSTITUTION_TSV = "chrom string, start long, end long, consensus string, strand string, score int, " + ", ".join(f"{a}{b} int" for a in "ACGT" for b in "ACGT")


def read_fasta(spark: SparkSession, path: str, upper: bool = False) -> DataFrame:
    """header, chrom, seq of every record. Spark splits the files at record starts, so a file isn't read in one task.

    Lines are trimmed and blank ones skipped; what stands before the first '>' of a file is left out. Letter case is kept
    unless `upper` is set. An empty file gives no row.
    """
    raw = spark.read.text(path, lineSep="\n>")
    # only the first piece of a file still has its own '>'
    first = F.regexp_replace("value", r"^\s*>", "")
    rows = raw.select(F.when(F.col("value").rlike(r"^\s*>"), first).otherwise(F.col("value")).alias("v"), F.col("value").rlike(r"^\s*>").alias("marked"), F.col("_metadata.file_block_start").alias("_at"))
    rows = rows.where("length(trim(v)) > 0")
    header = F.trim(F.regexp_replace(F.substring_index("v", "\n", 1), "\r", ""))
    body = F.regexp_replace(F.expr("substring(v, instr(v, '\n') + 1)"), r"\s+", "")
    seq = F.when(F.instr("v", "\n") > 0, body).otherwise(F.lit(""))
    return rows.select(header.alias("header"), sequence_id(header).alias("chrom"), (F.upper(seq) if upper else seq).alias("seq"))


def write_fasta(records: DataFrame, path: str, header: str = "header", seq: str = "seq") -> None:
    """FASTA with 80 letters a line."""
    lines = F.when(F.length(seq) > 0, F.concat(F.lit(">"), F.col(header), F.lit("\n"), wrap80(F.col(seq)))).otherwise(F.concat(F.lit(">"), F.col(header)))
    records.select(lines.alias("value")).write.mode("overwrite").text(path)


def _fields(spark: SparkSession, path: str, sep: str) -> DataFrame:
    rows = spark.read.text(path).where("length(trim(value)) > 0 AND NOT startswith(value, '#')")
    return rows.select(F.split(F.trim("value") if sep == r"\s+" else F.col("value"), sep).alias("f"))


def read_bed(spark: SparkSession, path: str, sep: str = "\t", fourth: str = "family", empty: str | None = None) -> DataFrame:
    """chrom, start_pos, end_pos and the fourth column (`empty` where there is none). Comments, blank lines and lines of fewer
    than three fields are skipped; borders that are no integers are an error."""
    rows = _fields(spark, path, sep).where(F.size("f") >= 3)
    return rows.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("start_pos"), F.col("f")[2].cast("long").alias("end_pos"), F.when(F.size("f") > 3, F.col("f")[3]).otherwise(F.lit(empty)).alias(fourth))


def bed_lines(regions: DataFrame, chrom: Column, name: str | None = "name") -> DataFrame:
    """chrom, start_pos, end_pos and, for all rows if any is named, name with '.' for unnamed ones; one line column, value.

    Whether any is named is one row that is joined, not a window over everything.
    """
    base = regions.select(chrom.cast("string").alias("c"), "start_pos", "end_pos", (F.coalesce(F.col(name), F.lit("")) if name else F.lit("")).alias("n"))
    named = F.broadcast(base.agg(F.coalesce(F.max((F.col("n") != "").cast("int")), F.lit(0)).alias("_named")))
    three = F.concat_ws("\t", "c", "start_pos", "end_pos")
    return base.join(named).select(F.when(F.col("_named") == 1, F.concat_ws("\t", three, F.when(F.col("n") == "", ".").otherwise(F.col("n")))).otherwise(three).alias("value"))


def gtf_lines(regions: DataFrame, chrom: Column, order: list[str], source: str = "helixframe") -> DataFrame:
    """One line column, value: features with 1-based starts, numbered from 0 in the given order.

    Numbers are given in two steps, within ranges of the order and then over the ranges' sizes.
    """
    from helixframe.operators.ordering import numbered

    rows = numbered(regions.withColumn("_chrom", chrom.cast("string")), order, "_i")
    return rows.select(F.concat_ws("\t", "_chrom", F.lit(source), F.lit("repeat"), (F.col("start_pos") + 1).cast("string"), F.col("end_pos").cast("string"), F.lit("."), F.lit("."), F.lit("."), F.format_string('repeat_id "%d"', F.col("_i"))).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def read_tsv(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Tables with one header each; several are read as one. A line that doesn't fit the schema is an error."""
    return spark.read.csv(paths, sep="\t", header=True, schema=schema, mode="FAILFAST")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def parse_hit_table(lines: DataFrame, min_score: float | None = None, max_evalue: float | None = None, line: str = "value") -> DataFrame:
    """chrom, start_pos, end_pos, family, score, evalue of a profile-search table: fields between blanks, at least 16.

    The E-value is the 13th field, the score the 14th, places are 1-based and may run backwards; they come out 0-based and
    half-open. Lines with other numbers are skipped.
    """
    f = F.split(F.trim(line), r"\s+")
    rows = lines.where(~F.col(line).startswith("#")).select(f.alias("f")).where(F.size("f") >= 16)
    num = lambda i, t: F.expr(f"try_cast(f[{i}] AS {t})")
    a, b = num(6, "bigint"), num(7, "bigint")
    rows = rows.where(a.isNotNull() & b.isNotNull())
    name = F.col("f")[2]
    # Query names and the families they stand for.
    family = F.when(name.startswith("CR1"), "LINE/CR1").when(name == "MIR", "SINE/MIR").when(name == "L2", "LINE/L2").otherwise(name)
    out = rows.select(F.col("f")[0].alias("chrom"), (F.least(a, b) - 1).alias("start_pos"), F.greatest(a, b).alias("end_pos"), family.alias("family"), num(13, "double").alias("score"), num(12, "double").alias("evalue"))
    out = out.where("score IS NOT NULL AND evalue IS NOT NULL")
    out = out if min_score is None else out.where(F.col("score") >= min_score)
    return out if max_evalue is None else out.where(F.col("evalue") <= max_evalue)


def parse_alignment_table(lines: DataFrame, min_len: int = 500, min_identity: float = 90.0, header: int = 4, line: str = "value", number: str = "n") -> DataFrame:
    """s1, e1, s2, e2, len1, len2, identity, tag1, tag2 of a tab-separated table of pairwise alignments whose first lines are
    headers (number counts lines from 0): alignments of one sequence to itself, long and similar enough."""
    f = F.col("f")
    rows = lines.where(F.col(number) >= header).select(F.split(F.col(line), "\t").alias("f")).where(F.size("f") >= 9)
    out = rows.select(*[F.expr(f"try_cast(f[{i}] AS bigint)").alias(c) for i, c in enumerate(("s1", "e1", "s2", "e2", "len1", "len2"))], F.expr("try_cast(f[6] AS double)").alias("identity"), F.element_at(f, -2).alias("tag1"), F.element_at(f, -1).alias("tag2"))
    return out.where(f"tag1 = tag2 AND len1 >= {min_len} AND len2 >= {min_len} AND identity >= {min_identity}")


def histogram_lines(hist: DataFrame) -> DataFrame:
    """value: 'at least 2^bucket', seeds in it, seeds in it and above; from the highest bucket down."""
    return hist.orderBy(F.desc("bucket")).select(F.concat_ws("\t", F.pow(F.lit(2), "bucket").cast("long").cast("string"), F.col("n").cast("string"), F.col("at_least").cast("string")).alias("value"))


def library_headers(consensi: DataFrame) -> DataFrame:
    """header, seq of a consensus library."""
    return consensi.select(F.format_string("_fam_%05d len=%d support=%d occurrences=%d seed_count=%d", "id", F.length("seq"), "support", "occurrences", "seed_count").alias("header"), "seq")


def write_index(index: DataFrame, path: str, partitions: int | None = None, **about: object) -> None:
    """An index ordered by seed, in ranges, with its pattern, sample and least count beside it."""
    ranged = index.repartitionByRange(partitions, "kmer") if partitions else index.repartitionByRange("kmer")
    ranged.sortWithinPartitions("kmer").write.mode("overwrite").parquet(f"{path}/entries")
    index.sparkSession.createDataFrame([(k, str(v)) for k, v in about.items()] or [("version", "1")], "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def read_index(spark: SparkSession, path: str, **expected: object) -> DataFrame:
    """kmer, cnt; an error if what was written beside it differs from what is expected."""
    about = {r.name: r.value for r in spark.read.schema("name string, value string").json(f"{path}/about").collect()}
    for k, v in expected.items():
        if about.get(k) != str(v):
            raise ValueError(f"index has {k} {about.get(k)}, not {v}")
    return spark.read.parquet(f"{path}/entries")


def threshold_lines(thresholds: DataFrame) -> DataFrame:
    return thresholds.select(F.concat_ws("\t", "consensus", F.col("threshold").cast("string")).alias("value"))


def _numbers(col: str) -> Column:
    return F.array_join(F.transform(F.col(col), lambda x: F.format_string("%.6f", x)), "\t")


def model_lines(models: DataFrame, groups: DataFrame, thresholds: DataFrame) -> DataFrame:
    """value, place: a text model of all groups, then each consensus' group and offset, then the thresholds."""
    part = models.select(F.concat_ws("\n", F.concat_ws("\t", F.lit("#group"), "grp", F.col("tau").cast("string")), F.concat_ws("\t", F.lit("#logistic"), _numbers("w"), F.format_string("%.6f", "b0")), F.concat_ws("\t", F.lit("#mu"), _numbers("mu")), F.concat_ws("\t", F.lit("#sd"), _numbers("sd"))).alias("value"), F.lit(1).alias("place"))
    members = groups.select(F.concat_ws("\t", "consensus", "grp", F.format_string("%.6f", "shift")).alias("value"), F.lit(2).alias("place"))
    rest = thresholds.select(F.concat_ws("\t", F.lit("#threshold"), "consensus", F.col("threshold").cast("string")).alias("value"), F.lit(3).alias("place"))
    head = models.agg(F.concat(F.lit("#family_models\t"), F.count("*").cast("string")).alias("value"), F.lit(0).alias("place"))
    return head.unionByName(part).unionByName(members).unionByName(rest)


def set_tau(lines: DataFrame, tau: float, line: str = "value") -> DataFrame:
    """The lines of a model text with another cutoff for every group."""
    parts = F.split(F.col(line), "\t")
    return lines.withColumn(line, F.when(F.col(line).startswith("#group"), F.array_join(F.concat(F.slice(parts, 1, 2), F.array(F.lit(str(tau)))), "\t")).otherwise(F.col(line)))


#: Letters of a model text; it is read by the driver, as a model is small by nature.
MOST_MODEL = 50_000_000


def read_model_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """models (grp, w, mu, sd, b0, tau), groups (consensus, grp, shift) and thresholds (consensus, threshold) of a model text, as
    apply_models takes them. Texts above MOST_MODEL letters are an error."""
    size = spark.read.text(path, wholetext=True).agg(F.coalesce(F.sum(F.length("value")), F.lit(0))).first()[0]
    if size > MOST_MODEL:
        raise ValueError(f"a model of more than {MOST_MODEL} letters")
    texts = [r.value for r in spark.read.text(path, wholetext=True).collect()]
    groups, members, thresholds = read_models([x for t in texts for x in t.splitlines()])
    models = spark.createDataFrame([(g["grp"], g["w"], g["mu"], g["sd"], g["b0"], g["tau"]) for g in groups], "grp string, w array<double>, mu array<double>, sd array<double>, b0 double, tau double")
    return models, spark.createDataFrame([(c, *m) for c, m in members.items()], "consensus string, grp string, shift double"), spark.createDataFrame(list(thresholds.items()), "consensus string, threshold int")


def read_models(lines: list[str]) -> tuple[list[dict], dict[str, tuple[str, float]], dict[str, int]]:
    """Groups, members and thresholds of a model text; a text of two columns is thresholds only."""
    groups: list[dict] = []
    members: dict[str, tuple[str, float]] = {}
    thresholds: dict[str, int] = {}
    for line in lines:
        f = line.rstrip("\n").split("\t")
        if f[0] == "#group":
            groups.append({"grp": f[1], "tau": float(f[2])})
        elif f[0] == "#logistic":
            groups[-1] |= {"w": [float(x) for x in f[1:-1]], "b0": float(f[-1])}
        elif f[0] in ("#mu", "#sd"):
            groups[-1][f[0][1:]] = [float(x) for x in f[1:]]
        elif f[0] == "#threshold":
            thresholds[f[1]] = int(f[2])
        elif not f[0].startswith("#") and len(f) == 3:
            members[f[0]] = f[1], float(f[2])
        elif not f[0].startswith("#") and len(f) == 2:
            thresholds[f[0]] = int(f[1])
    return groups, members, thresholds
