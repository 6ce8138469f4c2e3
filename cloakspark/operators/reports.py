"""Residual reports, fidelity, status rules and the two example analyses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakspark.functions import patterns as P
from cloakspark.functions import text as T


def _counted(clean: Column, low: Column, name: str, pattern: str, ignore_case: bool) -> Column:
    """Matches of a detector; a text without any of the words that every match holds isn't searched."""
    n = F.regexp_count(clean, F.lit(P.java(pattern, ignore_case))).cast("long")
    needs = P.RESIDUAL_NEEDS.get(name)
    return F.when(T.holds_any(low, needs), n).otherwise(F.lit(0).cast("long")) if needs else n


def with_findings(df: DataFrame, text: Column) -> tuple[DataFrame, dict[str, Column]]:
    """The frame with helper columns, and counts by detector of what is left in a plain text; placeholders are removed first, malformed ones counted."""
    df = df.withColumn("__text", F.coalesce(text, F.lit(""))).withColumn("__clean", F.regexp_replace("__text", P.PLACEHOLDER, ""))
    df = df.withColumn("__low", T.lowered(F.col("__clean")))
    counts = {name: _counted(F.col("__clean"), F.col("__low"), name, p, i) for name, p, i in P.TEXT_RESIDUALS}
    odd = F.size(F.filter(F.regexp_extract_all("__text", F.lit(r"<[^>\r\n]+>"), 0), lambda t: ~t.rlike(f"^{P.PLACEHOLDER}$")))
    return df, counts | {"malformed_placeholder": odd.cast("long")}


def residual_counts(df: DataFrame, text_col: str) -> DataFrame:
    """name, n: sums of all detectors over all rows."""
    df, found = with_findings(df.select(text_col), F.col(text_col))
    sums = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in found.items()])
    return sums.unpivot([], list(found), "name", "n")


def residual_records(df: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """Records that still hold something, malformed placeholders aside."""
    df, found = with_findings(df.select(*id_cols, text_col), F.col(text_col))
    total = sum((c for n, c in found.items() if n != "malformed_placeholder"), F.lit(0).cast("long"))
    return T.once(df, total, "findings", *id_cols).where("findings > 0")


def note_findings(notes: Column, clean: Column, low: Column, known: Column | None = None, rules=P.NOTE_RESIDUALS) -> dict[str, Column]:
    """Counts by detector of what is left in the notes of a row. clean: the notes after `text.without_known`; low: these after `text.plainly_lowered`."""
    none = F.lit(0).cast("long")
    email = F.regexp_count(clean, F.lit(P.java(P.TEXT_RESIDUALS[0][1]))).cast("long")
    out: dict[str, Column] = {
        "email": F.when(clean.contains("@"), email).otherwise(none),
        "phone": F.regexp_count(clean, F.lit(P.java(P.TEXT_RESIDUALS[1][1]))).cast("long"),
        "malformed_placeholder": T.unknown_tokens(notes, known).cast("long"),
    }
    for rule in rules:
        name, p, i = rule
        n = F.size(F.filter(F.regexp_extract_all(clean, F.lit(P.java(p, i)), 1), lambda v: F.btrim(v) != "")).cast("long")
        n = F.when(_may_match(low, rule), n).otherwise(none)
        out[name] = out[name] + n if name in out else n
    return out


def _may_match(low: Column, rule: tuple[str, str, bool]) -> Column:
    """Whether a detector of notes may find something in a text as `text.plainly_lowered` gives it; a detector without known words always may."""
    needs = P.NOTE_NEEDS.get(tuple(rule))
    return T.may_hold(low, needs) if needs else F.lit(True)


def note_counts(df: DataFrame, row_id: str, columns: list[str], first: str, last: str, address: str, known: Column | None = None, rules=P.NOTE_RESIDUALS) -> DataFrame:
    """row_id and a count per detector for every row: what its notes (columns) still hold, and how often they hold its own full name and address, in any case.

    first, last, address: the row's original values; null ones are empty, and empty ones are never found.
    """
    c = lambda n: F.btrim(F.coalesce(F.col(n), F.lit("")))
    name = F.btrim(F.concat_ws(" ", F.nullif(c(first), F.lit("")), F.nullif(c(last), F.lit(""))))
    text = lambda n: F.coalesce(F.col(n), F.lit(""))
    own = {label: sum([occurrences(text(n), value) for n in columns], F.lit(0).cast("long")) for label, value in (("known_name", name), ("known_address", c(address)))}
    notes = F.concat_ws("\n", *[text(n) for n in columns])
    df = df.withColumn("__notes", notes).withColumn("__clean", T.without_known(F.col("__notes"), known)).withColumn("__low", T.plainly_lowered(F.col("__clean")))
    found = note_findings(F.col("__notes"), F.col("__clean"), F.col("__low"), known, rules) | own
    return df.select(row_id, *[n.alias(label) for label, n in found.items()])


def note_report(counts: DataFrame, row_id: str) -> DataFrame:
    """name, n: sums of `note_counts` over all rows."""
    labels = [c for c in counts.columns if c != row_id]
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in labels]).unpivot([], labels, "name", "n")


def affected_rows(counts: DataFrame, row_id: str) -> DataFrame:
    """row: numbers, from 1, of the rows that still hold something. row_id is dense from 0."""
    some = reduce(lambda a, b: a | b, [F.col(c) > 0 for c in counts.columns if c != row_id])
    return T.once(counts, some, "__some", row_id).where("__some").select((F.col(row_id) + 1).alias("row"))


def report_status(counts: DataFrame, row_id: str) -> DataFrame:
    """One row: status, residual_count, affected_row_count."""
    total = sum([F.col(c) for c in counts.columns if c != row_id], F.lit(0).cast("long"))
    sums = counts.agg(F.coalesce(F.sum(total), F.lit(0)).alias("residual_count"), F.count_if(total > 0).alias("affected_row_count"))
    return sums.select(F.when(F.col("residual_count") == 0, "passed").otherwise("completed_with_warnings").alias("status"), "residual_count", "affected_row_count")


def contextual_rows(df: DataFrame, row_id: str, columns: list[str], known: Column | None = None, rules=P.NOTE_RESIDUALS) -> DataFrame:
    """Rows whose notes still match a contextual detector."""
    notes = F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    clean = df.select(row_id, T.without_known(notes, known).alias("clean")).withColumn("__low", T.plainly_lowered(F.col("clean")))
    hits = F.lit(False)
    for rule in rules:
        _, p, i = rule
        hits = hits | (_may_match(F.col("__low"), rule) & F.exists(F.regexp_extract_all("clean", F.lit(P.java(p, i)), 1), lambda v: F.btrim(v) != ""))
    return T.once(clean, hits, "__hit", row_id).where("__hit").select(row_id)


def occurrences(text: Column, value: Column) -> Column:
    """How often a value stands in a text, ignoring case, without overlap; 0 for an empty value."""
    t, v = F.lower(text), F.lower(value)
    return F.when(F.length(v) == 0, 0).otherwise(((F.length(t) - F.length(F.replace(t, v, F.lit("")))) / F.length(v)).cast("long"))


def number_key(text: Column) -> Column:
    """Equal for texts that are numbers of the same value, whatever their length and spelling; null for any other text."""
    form = r"^\s*([+-]?)(?:(\d+)\.?(\d*)|()\.(\d+))(?:[eE]([+-]?\d{1,18}))?\s*$"
    part = lambda k: F.regexp_extract(text, form, k)
    fraction = F.concat(part(3), part(5))
    digits = F.ltrim(F.concat(part(2), fraction), F.lit("0"))
    short = F.rtrim(digits, F.lit("0"))
    power = F.coalesce(F.nullif(part(6), F.lit("")).cast("long"), F.lit(0)) - F.length(fraction) + F.length(digits) - F.length(short)
    endless = F.lower(F.btrim(F.regexp_replace(text, r"^\s*\+", "")))
    number = F.when(short == "", "0").otherwise(F.concat(F.when(part(1) == "-", "-").otherwise(""), short, F.lit("e"), power.cast("string")))
    return F.when(text.rlike(form), number).when(endless.isin("inf", "infinity"), "inf").when(endless.isin("-inf", "-infinity"), "-inf")


def fidelity(source: DataFrame, returned: DataFrame, row_id: str) -> DataFrame:
    """One row: exact and semantic share of equal fields, fields and rows changed; not applicable if the numbers of rows differ.

    Rows are matched by `row_id`. Fields are equal semantically if both are numbers of the same value.
    """
    fields = [c for c in source.columns if c != row_id]
    s = source.select(row_id, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"s_{c}") for c in fields])
    r = returned.select(row_id, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"r_{c}") for c in fields])
    exact = {c: F.col(f"s_{c}") == F.col(f"r_{c}") for c in fields}
    semantic = {c: exact[c] | F.coalesce(number_key(F.col(f"s_{c}")) == number_key(F.col(f"r_{c}")), F.lit(False)) for c in fields}
    total = lambda d: sum((x.cast("long") for x in d.values()), F.lit(0).cast("long"))
    rows = s.join(r, row_id, "full_outer").select(
        F.col(f"s_{fields[0]}").isNotNull().alias("mine"), F.col(f"r_{fields[0]}").isNotNull().alias("theirs"), total(exact).alias("exact"), total(semantic).alias("semantic")
    )
    sums = rows.agg(F.count_if("mine").alias("n"), F.count_if("theirs").alias("m"), F.count("*").alias("both"), F.sum("exact").alias("exact"), F.sum("semantic").alias("semantic"), F.count_if(F.col("exact") < len(fields)).alias("rows_changed"))
    cells = F.col("n") * len(fields)
    applies = (F.col("n") == F.col("m")) & (F.col("n") == F.col("both"))
    say = lambda c: F.when(applies, c).otherwise("Not applicable")
    return sums.select(
        say(T.percentage(F.col("exact"), cells)).alias("exact_field_fidelity"), say(T.percentage(F.col("semantic"), cells)).alias("semantic_field_fidelity"),
        say((cells - F.col("exact")).cast("string")).alias("fields_changed"), say(F.col("rows_changed").cast("string")).alias("rows_changed"),
    )


def third_party_status(payload: Column) -> Column:
    """Of a JSON payload: failed, file_drop, skipped or processed."""
    error = lambda k: F.coalesce(F.get_json_object(payload, f"$.{k}"), F.lit("")) != ""
    status = F.lower(F.btrim(F.coalesce(F.get_json_object(payload, "$.status"), F.lit(""))))
    return F.when(error("errorType") | error("errorMessage"), "failed").when(status.isin("file_drop", "skipped", "failed"), status).otherwise("processed")


def rehydration_status(status: Column, returned: Column) -> Column:
    """What became of restoration, from the third party's status and the number of returned tokens."""
    return (
        F.when(status == "failed", "not_run_third_party_failed").when(status == "file_drop", "not_run_external_file_handoff").when(status == "skipped", "not_run_external_processing_skipped")
        .when(returned == 0, "not_required_no_placeholders_returned").otherwise("completed")
    )


def number(c: Column) -> Column:
    """The cell as a number, 0 where it isn't one."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def utilisation(balance: Column, limit: Column) -> Column:
    """Balance over limit, 0 without a positive limit."""
    return F.when(limit > 0, balance / limit).otherwise(0.0)


def credit_profiles(df: DataFrame) -> DataFrame:
    """Profiles with utilisation and flag. df: customer_id, name, segment, limit, balance (as text)."""
    limit, balance = number(F.col("credit_limit")), number(F.col("balance"))
    u = utilisation(balance, limit)
    return df.select("customer_id", "name", F.struct(F.col("segment").alias("type"), limit.alias("limit"), balance.alias("balance")).alias("card"), u.alias("utilisation"), (u >= 0.8).alias("high"))


#: Structs of a customer's profile: field, column of the table, whether it is a number.
PROFILE = {
    "account": (("type", "Account Type", False), ("balance", "Account Balance", True), ("opened", "Date Of Account Opening", False)),
    "loan": (("loan_id", "Loan ID", False), ("amount", "Loan Amount", True), ("type", "Loan Type", False), ("status", "Loan Status", False)),
    "card": (("card_id", "CardID", False), ("type", "Card Type", False), ("credit_limit", "Credit Limit", True), ("balance", "Credit Card Balance", True)),
    "feedback": (("type", "Feedback Type", False), ("resolution", "Resolution Status", False)),
}


def customer_profiles(df: DataFrame) -> DataFrame:
    """Nested profiles of a customer table, with utilisation and flag. Missing columns and null cells are empty, or 0 for numbers."""
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in df.columns else F.lit("")
    name = F.btrim(F.concat(F.btrim(cell("First Name")), F.lit(" "), F.btrim(cell("Last Name"))))
    parts = [F.struct(*[(number(cell(c)) if numeric else cell(c)).alias(f) for f, c, numeric in entries]).alias(part) for part, entries in PROFILE.items()]
    u = utilisation(number(cell("Credit Card Balance")), number(cell("Credit Limit")))
    plain = [cell("Customer ID").alias("customer_id"), name.alias("name"), number(cell("Age")).cast("int").alias("age"), *[cell(c).alias(c.lower()) for c in ("Gender", "City", "Email")]]
    return df.select(*plain, *parts, u.alias("utilisation"), (u >= 0.8).alias("high"))


def credit_stats(profiles: DataFrame) -> DataFrame:
    """One row: customers, flagged ones, mean utilisation."""
    return profiles.agg(F.count("*").alias("total"), F.count_if("high").alias("flagged"), F.coalesce(F.avg("utilisation"), F.lit(0.0)).alias("mean_utilisation"))


def privacy_types(text: Column) -> Column:
    """Names of the privacy types of a record, in their fixed order."""
    return _named_types([_holds_type(text, T.plainly_lowered(text), name, ps) for name, _, ps in P.PRIVACY_TYPES])


def _holds_type(text: Column, low: Column, name: str, ps: tuple[str, ...]) -> Column:
    """Whether a record is of a type, by one search for all its patterns; a text without any of the words that every match holds isn't searched."""
    return T.may_hold(low, P.PRIVACY_NEEDS[name]) & text.rlike(P.java("(?:" + "|".join(ps) + ")", True))


def _named_types(hits: list[Column]) -> Column:
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for hit, (name, _, _) in zip(hits, P.PRIVACY_TYPES, strict=True)]))


def privacy_risk(df: DataFrame, text_col: str) -> DataFrame:
    """The frame with types, calculation, score and risk of each record."""
    names = {f"__type_{k}": (name, ps) for k, (name, _, ps) in enumerate(P.PRIVACY_TYPES)}
    df = df.withColumn("__low", T.plainly_lowered(F.col(text_col)))
    df = df.withColumns({c: _holds_type(F.col(text_col), F.col("__low"), *t) for c, t in names.items()})
    hits, weights = [F.col(c) for c in names], [w for _, w, _ in P.PRIVACY_TYPES]
    score = sum((F.when(hit, w).otherwise(0) for hit, w in zip(hits, weights, strict=True)), F.lit(0))
    calculation = F.concat_ws(" + ", *[F.when(hit, F.lit(str(w))) for hit, w in zip(hits, weights, strict=True)])
    df = df.withColumns({"types": _named_types(hits), "score": score, "calculation": F.coalesce(F.nullif(calculation, F.lit("")), F.lit("0"))}).drop("__low", *names)
    risk = F.when(F.col("types") == F.array(F.lit("Medical Info")), "Medium").when(F.col("score") >= 8, "High").when(F.col("score") >= 4, "Medium").otherwise("Low")
    return df.withColumn("risk", risk)


def record_fields(text: Column) -> dict[str, Column]:
    """Name, address, e-mail and phone of a record: the first pattern that matches, trimmed; null for none."""
    out = {}
    for name, ps in P.RECORD_FIELDS:
        first = F.coalesce(*[F.nullif(F.regexp_extract(text, P.java(p, True), 1), F.lit("")) for p in ps])
        out[name] = F.nullif(F.btrim(first, F.lit(" \t\r\n,.;")), F.lit(""))
    return out
