"""Tables put together from archives: institutional filings and positions, filers and filings, facts and concepts, filing indexes and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import latest_per, text_date
from ..functions.scratch import scratch
from ..sources.documents import shred_columnar, shred_facts, shred_xbrl_checked
from .derive import name_key, resolve_names

#: From this filing date on, values of positions are filed in dollars, before it in thousands. Fixed value.
DOLLARS_FROM = "2023-01-01"
#: Fields of a filing in the filers' documents. Fixed values of the format.
FILING_FIELDS = [
    "accessionNumber", "filingDate", "reportDate", "acceptanceDateTime", "act", "form", "fileNumber", "filmNumber", "items", "core_type", "size", "isXBRL", "isInlineXBRL", "isXBRLNumeric",
    "primaryDocument", "primaryDocDescription",
]


def _number(c: str) -> Column:
    return F.trim(c).try_cast("double")


def _blank(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def filings_13f(submissions: DataFrame, covers: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row for each filing: dates by their format, the manager of its cover page, the amendment flag and the totals of its summary page.

    Amendments stay beside what they amend. Filings without a cover or a summary have nulls there; of repeated covers or summaries one counts.
    """
    one = lambda df, *order: latest_per(df, ["accession_number"], [F.col(c).desc_nulls_last() for c in order])
    c = one(covers, *[x for x in covers.columns if x != "accession_number"]).select(
        "accession_number", F.col("filingmanager_name").alias("manager"), F.col("filingmanager_city").alias("manager_city"), F.col("filingmanager_stateorcountry").alias("manager_state"), F.col("crdnumber").alias("crd_number"),
        F.col("reporttype").alias("report_type"), F.coalesce(F.lower(F.trim("isamendment")).isin("y", "yes", "true", "1"), F.lit(False)).alias("is_amendment"), F.col("amendmentno").alias("amendment_no"), F.col("amendmenttype").alias("amendment_type"),
    )
    p = one(summaries, "tableentrytotal", "tablevaluetotal").select("accession_number", F.trim("tableentrytotal").try_cast("long").alias("positions_reported"), _number("tablevaluetotal").alias("value_total_raw"))
    s = submissions.select("accession_number", "cik", text_date("filing_date", "d-MMM-yyyy").alias("filed"), text_date("periodofreport", "d-MMM-yyyy").alias("period"), F.col("submissiontype").alias("submission_type"))
    t = s.join(c, "accession_number", "left").join(p, "accession_number", "left")
    return t.withColumn("is_amendment", F.coalesce("is_amendment", F.lit(False))).withColumnRenamed("accession_number", "accn")


def positions_13f(filings: DataFrame, info: DataFrame, dollars_from: str = DOLLARS_FROM) -> DataFrame:
    """One row for each position of a known filing; the value as filed and in dollars, by the convention in force when it was filed."""
    f = filings.select("accn", "cik", "filed", "period", "manager", "is_amendment")
    i = info.select(
        F.col("accession_number").alias("accn"), F.col("infotable_sk").alias("position_sk"), F.col("nameofissuer").alias("issuer"), F.col("titleofclass").alias("class"), "cusip", _blank("figi").alias("figi"), _number("value").alias("value_raw"),
        _number("sshprnamt").alias("shares"), F.col("sshprnamttype").alias("shares_type"), _blank("putcall").alias("put_call"), F.col("investmentdiscretion").alias("discretion"),
        *[_number(f"voting_auth_{k}").alias(f"voting_{k}") for k in ("sole", "shared", "none")],
    )
    usd = F.when(F.col("filed") >= F.lit(dollars_from).cast("date"), F.col("value_raw")).otherwise(F.col("value_raw") * 1000)
    return i.join(f, "accn").withColumn("value_usd", usd)


def submissions_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(filers, filings) of an archive's members docs(member, json): each filer's main document, and its overflow documents with older filings.

    A document that doesn't parse gives no rows. Lists are comma-joined, '' is null. filing_count counts rows of all the filer's documents.
    """
    file = F.element_at(F.split("member", "/"), -1)
    base = F.regexp_replace(F.split(file, "-submissions-")[0], r"\.json$", "")
    named = docs.where(file.endswith(".json")).select(base.alias("base"), file.contains("-submissions-").alias("overflow"), "json")
    digits = F.regexp_replace(F.coalesce(F.get_json_object("json", "$.cik"), F.substring("base", 4, 10)), "^0+", "")
    mains = named.where(~F.col("overflow")).select("base", F.when(digits == "", "0").otherwise(digits).alias("cik"), "json").where(F.get_json_object("json", "$").isNotNull())
    more = named.where("overflow").join(mains.select("base", "cik"), "base").select("cik", "json")
    filings = shred_columnar(mains.select("cik", "json").unionByName(more), "json", FILING_FIELDS)
    shape = "struct<name: string, tickers: array<string>, exchanges: array<string>, sic: string, sicDescription: string, entityType: string, ein: string, fiscalYearEnd: string, category: string, stateOfIncorporation: string, formerNames: array<struct<name: string>>>"
    d = mains.select("cik", F.from_json("json", shape).alias("d"))
    listed = lambda c: F.nullif(F.array_join(F.array_compact(c), ","), F.lit(""))
    filers = d.select(
        "cik", "d.name", listed(F.col("d.tickers")).alias("tickers"), listed(F.col("d.exchanges")).alias("exchanges"), "d.sic", F.col("d.sicDescription").alias("sic_description"), F.col("d.entityType").alias("entity_type"), "d.ein",
        F.col("d.fiscalYearEnd").alias("fiscal_year_end"), "d.category", F.col("d.stateOfIncorporation").alias("state_of_incorporation"), listed(F.transform("d.formerNames", lambda x: x["name"])).alias("former_names"),
    )
    counted = filings.groupBy("cik").agg(F.count("*").alias("filing_count"))
    return filers.join(counted, "cik", "left").withColumn("filing_count", F.coalesce("filing_count", F.lit(0))), filings


def facts_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, concepts) of an archive's members docs(member, json): typed facts of each filer, and one label for each (taxonomy, concept).

    The label is that of the first member by name. Values that aren't numbers become null and stay in val_raw.
    """
    file = F.element_at(F.split("member", "/"), -1)
    digits = F.regexp_replace(F.coalesce(F.get_json_object("json", "$.cik"), F.substring(file, 4, 10)), "^0+", "")
    named = docs.where(file.endswith(".json")).select(file.alias("member"), F.when(digits == "", "0").otherwise(digits).alias("cik"), "json")
    tree = F.from_json(F.get_json_object("json", "$.facts"), "map<string, map<string, struct<label: string, description: string>>>")
    a = named.select("member", F.explode(tree).alias("taxonomy", "cs")).select("member", "taxonomy", F.explode("cs").alias("concept", "c"))
    first = F.min(F.struct("member", "c.label", "c.description"))
    concepts = a.groupBy("taxonomy", "concept").agg(first.alias("m")).select("taxonomy", "concept", "m.label", "m.description")
    return shred_facts(named.select("cik", "json")), concepts


def concept_labels(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """Concepts in use with their label and how many facts and filers have them; concepts without facts have none."""
    n = facts.groupBy("taxonomy", "concept").agg(F.count("*").alias("facts"), F.countDistinct("cik").alias("filers"))
    return concepts.join(n, ["taxonomy", "concept"], "left").select("taxonomy", "concept", "label", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("filers", F.lit(0)).alias("filers"))


def filing_jobs(index: DataFrame) -> DataFrame:
    """Distinct XBRL filings of index rows (filing_type, symbol, company, url, file): the last listed symbol and company of each url count."""
    t = index.where(F.lower(F.trim("url")).endswith(".xml")).withColumn("url", F.trim("url"))
    last = latest_per(t, ["filing_type", "url"], [F.col("file").desc_nulls_last(), F.col("symbol").desc_nulls_last(), F.col("company").desc_nulls_last()])
    return last.select("filing_type", F.trim("symbol").alias("source_symbol"), F.trim("company").alias("source_company"), F.col("url").alias("xbrl_url"))


def filing_facts(jobs: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, rejects): filings joined to documents(xbrl_url, xml) and shredded in one pass, written once.

    rejects has (filing_type, file, record, reason, raw) of each filing without a document or without facts; record is its symbol.
    """
    found = jobs.join(documents.select("xbrl_url", "xml"), "xbrl_url", "left")
    at = scratch(jobs.sparkSession, "filing-facts")
    shred_xbrl_checked(found).write.parquet(at)
    rows = jobs.sparkSession.read.parquet(at)
    rejects = rows.where("problem is not null").select("filing_type", F.col("xbrl_url").alias("file"), F.col("source_symbol").alias("record"), F.col("problem").alias("reason"), "raw")
    return rows.where("problem is null").drop("problem", "raw"), rejects


def insider_store(index: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """filing_facts() of the insider filings of an index: one store of rows as filed."""
    return filing_facts(filing_jobs(index.where("filing_type = 'insider'")), documents)


def per_day_facts(index: DataFrame, documents: DataFrame, types: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Facts of each day's filings, (as_of, filing_type, ...): index rows also have their day as_of.

    types: the filing types taken, all by default. most: how many filings of a type and day, in the order of their url; None takes all.
    """
    rows = index if types is None else index.where(F.col("filing_type").isin(types))
    jobs = filing_jobs(rows.withColumn("filing_type", F.concat_ws("|", "as_of", "filing_type")))
    if most is not None:
        jobs = jobs.withColumn("_n", F.row_number().over(W.partitionBy("filing_type").orderBy("xbrl_url"))).where(F.col("_n") <= most).drop("_n")
    facts, _ = filing_facts(jobs, documents)
    part = F.split("filing_type", r"\|")
    return facts.select(part[0].cast("date").alias("as_of"), part[1].alias("filing_type"), *[c for c in facts.columns if c != "filing_type"])


def shareholding_index(index: DataFrame) -> DataFrame:
    """Typed rows of the filing index; columns are known by their names, which differ between files: (company, as_on_date, percentages, ...).

    Rows without a company or a date that parses go. Percentages keep no thousands commas; '-' is unknown.
    """
    have = {c.upper().strip(): c for c in index.columns}
    text = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(f"`{have[n]}`")), F.lit("")) for n in names if n in have], F.lit(None).cast("string"))
    day = lambda c: text_date(F.split(c, r"\s+")[0], "d-MMM-yyyy", "d-MMMM-yyyy", "yyyy-MM-dd")
    share = lambda c: F.regexp_replace(F.nullif(c, F.lit("-")), ",", "").try_cast("double")
    t = index.select(
        text("COMPANY", "COMPANY NAME").alias("company"), day(text("AS ON DATE")).alias("as_on_date"), share(text("PROMOTER & PROMOTER GROUP (A)")).alias("promoter_pct"), share(text("PUBLIC (B)")).alias("public_pct"),
        share(text("SHARES HELD BY EMPLOYEE TRUSTS (C2)")).alias("employee_trust_pct"), text("STATUS").alias("status"), day(text("SUBMISSION DATE")).alias("submission_date"), text("ACTION").alias("xbrl_url"), text("FILE_PATH").alias("file"),
    )
    return t.where("company is not null and as_on_date is not null").withColumn("company_key", name_key(F.col("company")))


def shareholding_store(index: DataFrame, bridge: DataFrame) -> DataFrame:
    """One row for each company and quarter of shareholding_index(), the latest submission, with the symbol that the bridge gives its name."""
    order = [F.col("submission_date").desc_nulls_last(), F.col("file").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in ("company", "promoter_pct", "public_pct", "xbrl_url")]]
    best = latest_per(index, ["company_key", "as_on_date"], order)
    symbols = resolve_names(best.select(F.col("company").alias("name")), bridge).select(F.col("name").alias("company"), "symbol")
    return best.join(symbols, "company", "left").select("symbol", "company", "company_key", "as_on_date", "promoter_pct", "public_pct", "employee_trust_pct", "status", "submission_date", "xbrl_url")
