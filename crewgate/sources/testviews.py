"""Stand-in inputs built from the driver's test tables (see FIXTURES.md).

These functions only give rows in the schemas the operators expect; they do
none of the operators' work.  Every view is a projection of one test table,
so it grows with the scale factor and keeps parquet pushdown/pruning.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewgate.schema import COMPANIES, ROLES, WORKERS, conform

# Fixed value: the "today" of every registered query.
AS_OF = dt.date(1998, 6, 30)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mod(c: str, n: int):
    return F.col(c) % n


def _pad_name(prefix: str, key) -> F.Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), 9, "0"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return conform(c.select(
        F.col("c_custkey").alias("company_id"),
        F.col("c_name").alias("company_name"),
        F.when(_mod("c_custkey", 6) == 0, F.lit(""))
         .otherwise(F.concat(F.lit("IT"), _mod("c_custkey", 1200).cast("string")))
         .alias("vat_number"),
        F.col("c_mktsegment").alias("contact_name"),
        F.lower(F.concat(F.regexp_replace("c_name", "#", "."), F.lit("@example.org")))
         .alias("contact_email"),
        F.concat(F.lit("+39 "), F.col("c_nationkey").cast("string")).alias("contact_phone"),
        F.lit("").alias("note"),
        F.when(F.col("c_acctbal") < 0, F.lit(1)).otherwise(F.lit(0)).alias("is_sole_trader"),
    ), COMPANIES)


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return conform(s.select(F.col("s_suppkey").alias("role_id"),
                            F.col("s_name").alias("role_name")), ROLES)


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    temporary = F.col("o_orderstatus") == "P"
    return conform(o.select(
        k.alias("worker_id"),
        F.expr("substring(o_orderpriority, 3)").alias("given_name"),
        F.concat(F.lit("S"), (k % 997).cast("string")).alias("surname"),
        F.col("o_custkey").alias("company_id"),
        F.when(k % 4 == 0, k % 137).alias("role_id"),
        F.when(k % 3 != 0, F.lit(1)).otherwise(F.lit(0)).alias("badge_issued"),
        F.when(k % 13 != 0, F.col("o_orderdate").cast("date")).alias("expiry_date"),
        F.when(k % 2 == 0, F.lit(1)).otherwise(F.lit(0)).alias("record_updated"),
        F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2", "3"), F.lit(1))
         .otherwise(F.lit(0)).alias("badge_valid"),
        F.col("o_orderstatus").alias("note"),
        F.when(k % 11 == 0, F.lit(None)).when(k % 10 == 0, F.lit(1)).otherwise(F.lit(0))
         .alias("badge_cancelled"),
        F.when(temporary, F.lit(1)).otherwise(F.lit(0)).alias("is_temporary"),
        F.when(temporary, F.concat(F.lit("T"), k.cast("string"))).otherwise(F.lit(""))
         .alias("badge_number"),
    ), WORKERS)


def recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.when(_mod("s_suppkey", 3) == 0, F.lit("weekly")).otherwise(F.lit("expired"))
         .alias("list_name"),
        F.when(_mod("s_suppkey", 10) == 5, F.lit("  "))
         .otherwise(F.lower(F.concat(F.regexp_replace("s_name", "#", "."),
                                     F.lit("@example.org"))))
         .alias("email"),
    )


def company_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New-company requests: names collide by case/blanks, VATs by value.  Of every
    24 requests 12 form a chain in which each shares its name with one neighbour
    and its VAT with the other, so that decisions depend on one another."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    vat = F.concat(F.lit("IT"), (k % 1700).cast("string"))
    chain, link = F.floor(k / 12), k % 12
    chained = chain % 2 == 0
    part = lambda tag, n: F.concat(F.lit(tag), chain.cast("string"), F.lit("-"),
                                   F.floor(n).cast("string"))
    return p.select(
        k.alias("seq"),
        F.when(chained, part("Chain ", link / 2)).when(k % 7 == 0, F.concat(F.lit("customer #"), F.lpad((k % 1500).cast("string"), 9, "0")))
         .when(k % 2 == 0, F.upper("p_name"))
         .otherwise(F.col("p_name")).alias("company_name"),
        F.when(chained, part("CH", (link + 1) / 2)).when(k % 5 == 0, F.lit(""))
         .when(k % 5 == 1, F.concat(F.lit(" "), vat, F.lit("\t")))
         .otherwise(vat).alias("vat_number"),
        F.repeat(F.col("p_name"), F.col("p_size")).alias("contact_name"),
        F.concat(F.regexp_replace("p_name", " ", "."), F.lit("@example.org")).alias("contact_email"),
        F.col("p_size").cast("string").alias("contact_phone"),
        F.col("p_type").alias("note"),
    )


def worker_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New-worker requests: copies of existing staff, new staff, bad input."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    branch = k % 6
    given = F.expr("substring(o_orderpriority, 3)")
    existing_company = _pad_name("Customer#", F.col("o_custkey"))
    return o.select(
        k.alias("seq"),
        F.when(branch == 0, F.lower(given)).otherwise(given).alias("given_name"),
        F.when(branch == 0, F.concat(F.lit("s"), (k % 997).cast("string")))
         .otherwise(F.concat(F.lit("New"), (k % 300).cast("string"))).alias("surname"),
        F.when(branch == 0, existing_company)
         .when(branch == 2, F.lit(""))
         .when(branch == 3, F.concat(F.lit("Ghost#"), k.cast("string")))
         .otherwise(_pad_name("CUSTOMER#", k % 40)).alias("company_name"),
        F.when(F.col("o_orderstatus") == "P", F.lit("on")).alias("is_temporary"),
        F.concat(F.lit("B"), k.cast("string")).alias("badge_number"),
        F.when(branch == 5, F.lit("abc")).when(k % 4 == 0, F.lit(""))
         .otherwise((k % 5).cast("string")).alias("role_id"),
        F.when(branch == 4, F.when(k % 4 == 0, F.lit("2024-02-30")).otherwise(F.lit("")))
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("expiry_date"),
        F.col("o_orderstatus").alias("note"),
    )


def worker_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit requests; every worker touched is edited about three times."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    target = F.floor(k / 3).cast("long") * 2
    return e.select(
        k.alias("seq"),
        F.when(k % 29 == 0, target + F.lit(1_000_000_000)).otherwise(target).alias("worker_id"),
        F.concat(F.lit("G"), k.cast("string")).alias("given_name"),
        F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("surname"),
        F.col("user_id").alias("company_id"),
        F.when(k % 31 == 0, F.lit("r")).when(k % 4 == 0, F.lit(""))
         .otherwise((k % 137).cast("string")).alias("role_id"),
        F.when(F.col("event_type") == "purchase", F.lit("on")).alias("is_temporary"),
        F.concat(F.lit("TB"), k.cast("string")).alias("badge_number"),
        F.when(k % 37 == 0, F.lit("2024-13-01")).when(k % 11 == 0, F.lit(""))
         .otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("expiry_date"),
        F.when(k % 13 == 0, F.lit("1")).otherwise(F.lit("0")).alias("clear_date_flag"),
        F.col("props").alias("note"),
    )


def company_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    target = F.floor(k / 4).cast("long")
    return e.select(
        k.alias("seq"),
        F.when(k % 53 == 0, target + F.lit(1_000_000_000)).otherwise(target).alias("company_id"),
        F.concat(F.lit("Firm "), F.col("user_id").cast("string")).alias("company_name"),
        F.concat(F.lit("IT"), k.cast("string")).alias("vat_number"),
        F.col("event_type").alias("contact_name"),
        F.concat(F.lit("e"), k.cast("string"), F.lit("@example.org")).alias("contact_email"),
        F.col("user_id").cast("string").alias("contact_phone"),
        F.col("props").alias("note"),
    )


def flag_change_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object per change (seq, actor, json), as a click feed sends them."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    field = (F.when(k % 101 == 0, F.lit("colour"))
             .when(F.col("event_type") == "click", F.lit("badge_issued"))
             .when(F.col("event_type") == "view", F.lit("badge_valid"))
             .when(F.col("event_type") == "purchase", F.lit("badge_cancelled"))
             .when(F.col("event_type") == "signup", F.lit("record_updated"))
             .otherwise(F.lit("is_sole_trader")))
    etype = (F.when(k % 103 == 0, F.lit("vehicle"))
             .when(F.col("event_type") == "error", F.lit("company"))
             .otherwise(F.lit("worker")))
    ident = (F.when(k % 109 == 0, F.lit(None).cast("long"))
             .when(k % 107 == 0, F.col("user_id") + F.lit(1_000_000_000))
             .otherwise(F.col("user_id")))
    on = F.col("value") > 50
    yes = lambda a, b: F.when(on, F.lit(a)).otherwise(F.lit(b))
    # the "clicked" token as JSON text: null, text, boolean, number; NULL = no such key
    clicked = (F.when(k % 79 == 0, F.lit("null"))
               .when(k % 97 == 0, F.lit('"2"')).when(k % 89 == 0, F.lit('"x"'))
               .when(k % 83 == 0, F.lit(None).cast("string"))
               .when(k % 73 == 0, yes("true", "false")).when(k % 67 == 0, yes("1.0", "0.0"))
               .when(k % 61 == 0, F.lit('"1.0"')).when(k % 59 == 0, yes("1", "0"))
               .otherwise(yes('"1"', '"0"')))
    number = ident.cast("string")
    json = F.concat(
        F.lit("{"), F.concat_ws(
            ",", F.concat(F.lit('"type":"'), etype, F.lit('"')),
            F.concat(F.lit('"id":'), F.when(k % 71 == 0, F.concat(F.lit('" '), number, F.lit(' "')))
                     .otherwise(number)),
            F.concat(F.lit('"field":"'), field, F.lit('"')),
            F.concat(F.lit('"clicked":'), clicked)),
        F.lit("}"))
    return e.select(k.alias("seq"),
                    F.concat(F.lit("user"), (F.col("user_id") % 4).cast("string")).alias("actor"),
                    json.alias("change"))


def company_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.where(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("seq"), F.col("c_custkey").alias("id"))


def repeated_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletion requests in another order than the ids: unknown, missing and repeated
    ids among them (the same list serves workers, companies and roles)."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    ident = F.col("user_id") % 331
    return e.select(k.alias("seq"),
                    F.when(k % 41 == 0, F.lit(None).cast("long"))
                     .when(k % 37 == 0, ident + F.lit(2_000_000_000)).otherwise(ident).alias("id"))


def company_remaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New ids of one market segment's companies."""
    c = table(spark, sf_dir, "customer")
    return c.where(F.col("c_mktsegment") == "MACHINERY").select(
        F.col("c_custkey").alias("seq"), F.col("c_custkey").alias("old_id"),
        (F.col("c_custkey") + F.lit(5_000_000_000)).alias("new_id"))


def company_key_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key changes that depend on one another: per 50 companies a chain into a free id,
    a swap through a third id, a cycle that nothing opens, several claims on one
    id, moves on of rows that have moved, ids that are not there and missing ids."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    group, link = F.floor(k / 50), k % 50
    base = group * 50
    free = base + F.lit(7_000_000_000)
    old = (F.when(link < 12, base + 12 - link)                       # chain: 12->free, 11->12, ...
            .when(link < 15, F.element_at(F.array(base + 13, base + 14, free + 1), (link - 11).cast("int")))
            .when(link < 20, base + link).when(link < 28, base + 20 + link % 2)
            .when(link < 32, free).when(link < 36, base + 30 + link % 3)
            .when(link == 36, base + F.lit(9_000_000_000)).when(link == 37, F.lit(None).cast("long"))
            .otherwise(base + link - 8))
    new = (F.when(link == 0, free).when(link < 12, base + 13 - link)
            .when(link < 15, F.element_at(F.array(free + 1, base + 13, base + 14), (link - 11).cast("int")))
            .when(link < 20, base + 15 + (link + 1) % 5).when(link < 28, free + 2 + link % 3)
            .when(link < 32, free + link).when(link < 36, base + 30 + link % 2)
            .when(link == 38, F.lit(None).cast("long")).when(link == 39, base + link - 8)
            .otherwise(base + (link * 7) % 50))
    return p.select(k.alias("seq"), old.cast("long").alias("old_id"), new.cast("long").alias("new_id"))


def mixed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that mixes additions and deletions of companies and workers: names that come
    free, companies added before their workers, repeated and unknown ids."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    kind, number = k % 8, (F.floor(k / 16) % 40).cast("string")
    op = (F.when(kind < 2, F.lit("add_company")).when(kind == 2, F.lit("delete_company"))
           .when(kind == 3, F.lit("delete_worker")).when(k % 16 == 7, F.lit("rename"))
           .otherwise(F.lit("add_worker")))
    stored = F.lpad((k % 97).cast("string"), 9, "0")
    company = (F.when(kind < 2, F.when(k % 3 == 0, F.concat(F.lit("Customer#"), stored)).otherwise(
                    F.concat(F.when(k % 4 < 2, F.lit("Mixed ")).otherwise(F.lit("MIXED")), number)))
                .when(k % 24 == 4, F.lit("")).when(k % 3 == 0, F.concat(F.lit("customer#"), stored))
                .otherwise(F.concat(F.lit("mixed "), number)))
    vat = (F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.concat(
        F.lit(" IT"), (k % 97).cast("string"), F.lit("\t")))
        .otherwise(F.concat(F.lit("MX"), (k % 50).cast("string"))))
    ident = (F.when(kind == 2, F.when(k % 5 == 0, None).when(k % 7 == 0, k + 1_000_000)
                     .otherwise(k % 97))
              .when(kind == 3, F.when(k % 11 == 0, None).otherwise((k * 3) % 400)))
    return p.select(
        k.alias("seq"), op.alias("op"), ident.cast("long").alias("id"),
        company.alias("company_name"), vat.alias("vat_number"), F.col("p_brand").alias("contact_name"),
        F.lit("").alias("contact_email"), F.lit(None).cast("string").alias("contact_phone"),
        F.col("p_type").alias("note"),
        F.concat(F.when(k % 2 == 0, F.lit("G")).otherwise(F.lit("g")),
                 (F.floor(k / 32) % 3).cast("string")).alias("given_name"),
        F.concat(F.lit("S"), (k % 5).cast("string")).alias("surname"),
        F.when(k % 6 == 0, F.lit("on")).alias("is_temporary"),
        F.concat(F.lit("B"), k.cast("string")).alias("badge_number"),
        F.when(k % 48 == 5, F.lit("abc")).when(k % 2 == 0, F.lit("")).otherwise(F.lit("3"))
         .alias("role_id"),
        F.when(k % 40 == 12, F.lit("2024-02-30")).when(k % 4 == 0, F.lit(""))
         .otherwise(F.lit("2024-05-01")).alias("expiry_date"))


def role_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.where(F.col("s_nationkey") == 7).select(
        F.col("s_suppkey").alias("seq"), F.col("s_suppkey").alias("id"))


def worker_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("id"))


# Fixed value: the stamp of every row of the upsert stand-in.
UPSERT_CREATED = dt.datetime(2024, 1, 1, 0, 0, 0)
UPSERT_NOW = dt.datetime(2024, 6, 1, 12, 0, 0)


def contact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert target: company contacts with created/updated stamps."""
    return companies(spark, sf_dir).select(
        "company_id", "contact_phone",
        F.lit(UPSERT_CREATED.isoformat(sep=" ")).cast("timestamp_ntz").alias("created_at"),
        F.lit(UPSERT_CREATED.isoformat(sep=" ")).cast("timestamp_ntz").alias("updated_at"))


def contact_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("seq"),
                    (F.col("o_custkey") * 2).alias("company_id"),
                    F.concat(F.lit("+39 "), F.col("o_orderkey").cast("string")).alias("contact_phone"))


# The two header records every raw roster file starts with.
RAW_HEADERS = ('Company;Given name;Surname;Note;"Expiry\ndate";Issued;Valid',
               'Roster of the site office;;;;;;')


def raw_roster_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of a raw roster, one worker per order, spread over files.

    Rows hold every irregularity the loader must take: '*'-wrapped and
    case-variant company names, tabs and NBSP round values, quoted ';' and
    quoted newlines, dates in d/M/yyyy, dd-MM-yyyy, impossible and two-digit
    forms, lower-case marks, over-long company names, names and notes, 2-field and
    8-field rows, rows whose only text is in field 9 or 12, and blank rows.
    """
    from crewgate.sources.roster_csv import csv_field
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    firm = (F.col("o_custkey") % 50).cast("string")
    company = (F.when(k % 41 == 0, F.repeat(F.lit("L"), 81))
                .when(k % 5 == 0, F.concat(F.lit("** Firm "), firm, F.lit(" *")))
                .when(k % 5 == 1, F.concat(F.lit("*FIRM "), firm))
                .otherwise(F.concat(F.lit("Firm "), firm)))
    given = F.when(k % 43 == 0, F.repeat(F.lit("G"), 51)).otherwise(
        F.expr("substring(o_orderpriority, 3)"))
    given = F.when(k % 7 == 0, F.concat(F.lit("\u00a0"), given, F.lit("\u2003"))) \
             .otherwise(F.concat(F.lit(" "), given, F.lit("\t")))
    surname = F.concat(F.lit("S"), (k % 997).cast("string"))
    note = (F.when(k % 47 == 0, F.repeat(F.lit("n"), 101)).when(k % 9 == 0, F.lit("a;b")).when(k % 17 == 0, F.lit("line1\nline2"))
             .otherwise(F.col("o_orderstatus")))
    d = F.col("o_orderdate")
    expiry = (F.when(k % 6 == 0, F.date_format(d, "dd/MM/yyyy"))
               .when(k % 6 == 1, F.date_format(d, "d/M/yyyy"))
               .when(k % 6 == 2, F.date_format(d, "d-M-yyyy"))
               .when(k % 6 == 3, F.lit("31/02/2024"))
               .when(k % 6 == 4, F.date_format(d, "dd/MM/yy"))
               .otherwise(F.lit("")))
    issued = F.when(k % 3 == 0, F.lit("X")).when(k % 3 == 1, F.lit(" x")).otherwise(F.lit(""))
    valid = F.when(k % 4 == 0, F.lit(" X ")).otherwise(F.lit(""))
    fields = [csv_field(c) for c in (company, given, surname, note, expiry, issued, valid)]
    line = (F.when(k % 29 == 0, F.lit(";;;;;;"))
             .when(k % 31 == 0, F.lit(";;;;;;;;y"))
             .when(k % 37 == 0, F.lit(' ;;"";;;;;;;;;z'))
             .when(k % 19 == 0, F.concat_ws(";", *fields[:2]))
             .when(k % 23 == 0, F.concat_ws(";", *fields, F.lit("extra")))
             .otherwise(F.concat_ws(";", *fields)))
    # a file holds 4,000 order numbers' rows: the file count grows with the table
    number = (F.floor(k / 16000) * 4 + k % 4).cast("string")
    data = o.select(F.lpad(number, 8, "0").alias("file_no"), k.alias("ord"), line.alias("value"))
    heads = data.select("file_no").distinct().select(
        "file_no", F.inline(F.array(*[
            F.struct(F.lit(i - len(RAW_HEADERS)).cast("long").alias("ord"), F.lit(h).alias("value"))
            for i, h in enumerate(RAW_HEADERS)])))
    return data.unionByName(heads)


def write_raw_roster(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Write the raw roster as CSV files, one folder each."""
    lines = raw_roster_lines(spark, sf_dir)
    (lines.repartition("file_no").sortWithinPartitions("file_no", "ord")
          .select("file_no", "value")
          .write.mode("error").partitionBy("file_no").text(path))
    return path


def write_change_files(spark: SparkSession, sf_dir: str, path: str, files: int = 4,
                       rows_per_file: int = 25_000) -> str:
    """The change records as JSON-lines files of at most ``rows_per_file`` records,
    ``files`` at least (their number, and that of the tasks that write them, grows with
    the table); records are spread by hash, so later files hold smaller seq values too
    (late arrivals)."""
    records = flag_change_records(spark, sf_dir)
    # a tenth of room for the spread of the hash, or most tasks would write a short second file
    files = max(files, -(-10 * records.count() // (9 * rows_per_file)))
    (records.repartition(files, "seq")
        .write.mode("error").option("maxRecordsPerFile", rows_per_file).json(path))
    return path
