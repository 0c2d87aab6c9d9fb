import pytest

from sparquill.operators import code as op

TEXT = """! Payment checks
INT PROC validate(a, b);
  INT a;  INT .p[0:9], q;
BEGIN
  ! STEP 1: check the account
  IF a = b THEN BEGIN
    CALL check_balance(a);
    $len(a);
  END;
  -- STEP 2 errors
  error := 8004;  ! "not a CALL x"
  WHILE a DO CALL log_it;
  RETURN other(a);
END;

PROC other(a);
BEGIN
  s := "BEGIN ! (";
  EXEC SQL SELECT name FROM t;
  CALL validate(a, b);
END;
"""


@pytest.fixture(scope="module")
def lines(spark):
    return op.lines(spark.createDataFrame([("f", TEXT)], "file string, text string"))


def test_procedures(lines):
    got = [(r.name, r.kind, r.return_type, r.start_line, r.end_line) for r in op.procedures(lines).orderBy("start_line").collect()]
    assert got == [("validate", "PROC", "INT", 2, 14), ("other", "PROC", None, 16, 21)]


def test_calls(lines):
    got = {(r.procedure, r.target, r.kind) for r in op.calls(lines, op.procedures(lines)).collect()}
    assert got == {("validate", "CHECK_BALANCE", "call"), ("validate", "LOG_IT", "call"), ("validate", "$LEN", "system"), ("validate", "OTHER", "function"), ("other", "VALIDATE", "call")}


def test_statements_and_rules(lines):
    kinds = {r.line_no: r.k for r in lines.select("line_no", op.statement_kind(op.F.col("code")).alias("k")).collect() if r.k}
    assert kinds[6] == "if" and kinds[7] == "call" and kinds[11] == "assign" and kinds[12] == "while" and kinds[13] == "return"
    rules = {(r.line_no, r.rule) for r in op.business_rules(lines).collect()}
    assert (6, "CONDITIONAL_LOGIC") in rules and (11, "ERROR_HANDLING") in rules and (7, "VALIDATION") in rules


def test_steps_symbols_sql_and_balance(lines):
    steps = {r.step: r for r in op.steps(lines).collect()}
    assert steps[1].calls == ["check_balance"] and "8004" in steps[2].errors
    assert {(r.name, r.is_pointer, r.bounds) for r in op.symbols(lines).collect()} >= {("p", True, "0:9"), ("q", False, None)}
    assert [(r.line_no, r.operation) for r in op.sql_operations(lines).collect()] == [(19, "SELECT")]
    assert {r.line_no: r.balance for r in op.parenthesis_balance(lines).collect()}[2] == 0
    assert op.comments(lines).where("line_no = 1").first().comment == "Payment checks"


def test_complexity(spark):
    df = spark.createDataFrame([("f", TEXT), ("e", "")], "file string, text string")
    assert {r.file: r.score for r in op.complexity(df).collect()}["e"] == 0
