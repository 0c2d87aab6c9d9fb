"""Source code as line tables: declarations, calls, rules, statements, procedures with their extent.

Each line is a row (file, line_no, line); what depends on earlier lines is a window over a file's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of the language that are no procedure or variable names.
KEYWORDS = ("IF", "THEN", "ELSE", "WHILE", "DO", "FOR", "CASE", "OF", "BEGIN", "END", "RETURN", "CALL", "AND", "OR", "NOT", "PROC", "SUBPROC", "INT", "STRING", "REAL", "FIXED", "UNSIGNED", "STRUCT", "LITERAL", "DEFINE", "GOTO", "SCAN", "RSCAN", "USE", "DROP", "ASSERT", "STOP", "TO", "BY", "DOWNTO", "UNTIL", "OTHERWISE", "MAIN", "FORWARD", "EXTERNAL")
PROCEDURE = r"(?i)^\s*(?:(INT(?:\(\d+\))?|REAL(?:\(\d+\))?|STRING|FIXED|UNSIGNED(?:\(\d+\))?)\s+)?(PROC|SUBPROC)\s+([A-Za-z_^][A-Za-z0-9_^]*)"
STATEMENTS = [("if", r"(?i)^\s*IF\b"), ("while", r"(?i)^\s*WHILE\b"), ("for", r"(?i)^\s*FOR\b"), ("case", r"(?i)^\s*CASE\b"), ("call", r"(?i)^\s*CALL\b"), ("return", r"(?i)^\s*RETURN\b"), ("goto", r"(?i)^\s*GOTO\b"), ("scan", r"(?i)^\s*R?SCAN\b"), ("assert", r"(?i)^\s*ASSERT\b"), ("stop", r"(?i)^\s*STOP\b"), ("move", r"^\s*'?[A-Za-z_^][\w^.\[\]]*\s*'(?::=|=:)'"), ("assign", r"^\s*[A-Za-z_^][A-Za-z0-9_^.\[\]()]*\s*:=")]
SQL = r"(?i)EXEC\s+SQL\s+(SELECT|INSERT|UPDATE|DELETE|DECLARE|OPEN|FETCH|CLOSE)"


def lines(files: DataFrame) -> DataFrame:
    """(file, line_no, line, code) of files (file, text): numbered from 1; code is the line without its comment and strings."""
    l = files.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    code = F.regexp_replace(F.regexp_replace("line", r'"[^"]*"', '""'), r"(--|!).*$", "")
    return l.select("file", (F.col("pos") + 1).alias("line_no"), "line", code.alias("code"))


def comments(rows: DataFrame) -> DataFrame:
    """(file, line_no, comment): what follows ! or --."""
    c = F.regexp_extract("line", r"(?:!|--)\s*(.*)$", 1)
    return rows.where(F.col("line").rlike(r"!|--")).select("file", "line_no", c.alias("comment"))


def procedures(rows: DataFrame) -> DataFrame:
    """(file, name, kind, return_type, start_line, end_line): declarations with the END that closes their first BEGIN.

    Depth is a running sum of BEGIN less END within each declaration.
    """
    decl = F.regexp_extract("code", PROCEDURE, 3)
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    at = rows.withColumn("nr", F.sum((decl != "").cast("int")).over(w)).where("nr > 0")
    begins = F.regexp_count("code", F.lit(r"(?i)\bBEGIN\b"))
    ends = F.regexp_count("code", F.lit(r"(?i)\bEND\b"))
    inner = Window.partitionBy("file", "nr").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumns({"depth": F.sum(begins - ends).over(inner), "seen": F.sum(begins).over(inner)})
    closing = F.min(F.when((F.col("seen") > 0) & (F.col("depth") <= 0), F.col("line_no"))).alias("close")
    spans = at.groupBy("file", "nr").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("last"), closing, F.min_by("code", "line_no").alias("head"))
    part = lambda k: F.nullif(F.upper(F.regexp_extract("head", PROCEDURE, k)), F.lit(""))
    return spans.select("file", F.regexp_extract("head", PROCEDURE, 3).alias("name"), part(2).alias("kind"), part(1).alias("return_type"), "start_line", F.coalesce("close", "last").alias("end_line"))


def within(rows: DataFrame, procs: DataFrame) -> DataFrame:
    """rows with the `procedure` whose extent holds them; a join on the file and a range of its lines."""
    p = procs.select(F.col("file").alias("f"), F.col("name").alias("procedure"), "start_line", "end_line")
    on = (F.col("file") == F.col("f")) & F.col("line_no").between(F.col("start_line"), F.col("end_line"))
    return rows.join(p.hint("merge"), on, "left").drop("f", "start_line", "end_line")  # never broadcast: as many rows as procedures


def calls(rows: DataFrame, procs: DataFrame) -> DataFrame:
    """(file, procedure, target, kind, line_no): the first call of each target in a procedure: CALL x, $x(, or a known x(; no keywords, not itself."""
    names = procs.select(F.upper("name").alias("known")).distinct()
    own = within(rows, procs).where("procedure IS NOT NULL")
    every = F.concat(
        F.transform(F.regexp_extract_all("code", F.lit(r"(?i)\bCALL\s+([A-Za-z_^][A-Za-z0-9_^]*)"), F.lit(1)), lambda t: F.struct(F.upper(t).alias("target"), F.lit("call").alias("kind"))),
        F.transform(F.regexp_extract_all("code", F.lit(r"(\$[A-Za-z]+)\s*\("), F.lit(1)), lambda t: F.struct(F.upper(t).alias("target"), F.lit("system").alias("kind"))),
        F.transform(F.regexp_extract_all("code", F.lit(r"([A-Za-z_^][A-Za-z0-9_^]*)\s*\("), F.lit(1)), lambda t: F.struct(F.upper(t).alias("target"), F.lit("function").alias("kind"))),
    )
    found = own.select("file", "procedure", "line_no", F.explode(every).alias("t")).select("file", "procedure", "line_no", "t.*")
    found = found.where(~F.col("target").isin(*KEYWORDS) & (F.col("target") != F.upper("procedure")))
    real = found.where("kind <> 'function'").unionByName(found.where("kind = 'function'").join(names.hint("merge"), F.col("target") == F.col("known"), "left_semi"))
    rank = F.when(F.col("kind") == "call", 0).when(F.col("kind") == "system", 1).otherwise(2)
    first = real.groupBy("file", "procedure", "target").agg(F.min(F.struct("line_no", rank.alias("rank"), "kind")).alias("m"))
    return first.select("file", "procedure", "target", "m.kind", "m.line_no")


def statement_kind(code: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, pattern in STATEMENTS:
        out = out.when(code.rlike(pattern), kind)
    return out


def business_rules(rows: DataFrame) -> DataFrame:
    """(file, line_no, rule): conditional logic, validation, error handling and data access; a line may have several."""
    c = F.upper("code")
    kinds = [("CONDITIONAL_LOGIC", c.rlike(r"\bIF\b.*\bTHEN\b")), ("VALIDATION", c.rlike(r"VALID|CHECK|VERIFY")), ("ERROR_HANDLING", c.rlike(r"ERROR|ABORT|FAIL")), ("DATA_ACCESS", c.rlike(r"\b(READ|WRITE|READUPDATE|WRITEUPDATE|KEYPOSITION|OPEN|CLOSE)\b"))]
    every = F.array_compact(F.array(*[F.when(test, F.lit(kind)) for kind, test in kinds]))
    return rows.select("file", "line_no", F.explode(every).alias("rule"))


def steps(rows: DataFrame) -> DataFrame:
    """(file, step, lines, errors, calls): lines from each `STEP n` comment to the next, with error codes and calls in them."""
    number = F.nullif(F.regexp_extract("line", r"(?i)(?:!|--).*\bSTEP\s+(\d+)", 1), F.lit("")).cast("int")
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    at = rows.withColumn("step", F.last(number, ignorenulls=True).over(w)).where("step IS NOT NULL")
    errors = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all("line", F.lit(r"\b(ERR[A-Z0-9_^]*|\d{4})\b"), F.lit(1))))))
    called = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all("code", F.lit(r"(?i)\bCALL\s+([A-Za-z_^][A-Za-z0-9_^]*)"), F.lit(1))))))
    return at.groupBy("file", "step").agg(F.count("*").alias("lines"), errors.alias("errors"), called.alias("calls"))


def symbols(rows: DataFrame) -> DataFrame:
    """(file, line_no, data_type, name, is_pointer, bounds): variables of declaration lines, one row each."""
    decl = r"(?i)^\s*(INT(?:\(\d+\))?|STRING|REAL(?:\(\d+\))?|FIXED(?:\(\d+\))?|UNSIGNED\(\d+\))\s+([^;]+);?"
    parts = rows.where(~F.col("code").rlike(r"(?i)\bPROC\b")).select("file", "line_no", F.explode(F.split("code", ";")).alias("code"))
    l = parts.where(F.col("code").rlike(decl))
    one = l.select("file", "line_no", F.upper(F.regexp_extract("code", decl, 1)).alias("data_type"), F.explode(F.split(F.regexp_extract("code", decl, 2), ",(?![^\\[]*\\])")).alias("v"))
    name = F.regexp_extract("v", r"^\s*\.?(?:EXT\s+)?\.?([A-Za-z_^][A-Za-z0-9_^]*)", 1)
    return one.select("file", "line_no", "data_type", name.alias("name"), F.col("v").rlike(r"^\s*\.").alias("is_pointer"), F.nullif(F.regexp_extract("v", r"\[([^\]]*)\]", 1), F.lit("")).alias("bounds")).where("name <> ''")


def sql_operations(rows: DataFrame) -> DataFrame:
    """(file, line_no, operation) of embedded SQL."""
    return rows.where(F.col("line").rlike(SQL)).select("file", "line_no", F.upper(F.regexp_extract("line", SQL, 1)).alias("operation"))


def parenthesis_balance(rows: DataFrame) -> DataFrame:
    """(file, line_no, opened, closed, balance): running balance of parentheses by line."""
    o, c = F.regexp_count("line", F.lit(r"\(")), F.regexp_count("line", F.lit(r"\)"))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("file", "line_no", o.alias("opened"), c.alias("closed"), F.sum(o - c).over(w).alias("balance"))


def complexity(files: DataFrame) -> DataFrame:
    """(file, score): thousands of characters up to 3, 0.3 for each call and 0.2 for each control word; 10 at most."""
    called = F.regexp_count("text", F.lit(r"(?i)\bCALL\b"))
    control = F.regexp_count("text", F.lit(r"(?i)\b(?:IF|WHILE|FOR|CASE)\b"))
    return files.select("file", F.round(F.least(F.lit(10.0), F.least(F.length("text") / 1000, F.lit(3.0)) + 0.3 * called + 0.2 * control), 6).alias("score"))
