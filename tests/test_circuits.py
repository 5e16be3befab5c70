"""Circuit text: parsing, folds, features, verification; small cases worked by hand."""

import pytest
from pyspark.sql import functions as F

from circuitscope.operators import expressions, qasm
from circuitscope.sources import readers

BELL = 'OPENQASM 2.0;\ninclude "qelib1.inc";\nqreg q[2];\ncreg c[2];\nh q[0];\ncx q[0],q[1];\nmeasure q -> c;\n'
RICH = """OPENQASM 2.0;
// a comment; with a semicolon
include "qelib1.inc";
gate mine a,b { cx a,b; h a; }
qreg a[2]; qreg b[1];
creg c[1];
rz(pi/2) a[0];
h a;
barrier a,b;
if (c==1) x b[0];
cx a[1],b[0];
measure b[0] -> c[0];
"""


def parsed(spark, *texts):
    return qasm.parse(spark.createDataFrame([(f"n{k}", t) for k, t in enumerate(texts)], "name string, qasm string"))


def test_bell(spark):
    row = parsed(spark, BELL).first()
    assert (row.num_qubits, row.num_clbits, row.problem) == (2, 2, None)
    assert [(o.op, o.qubits, o.clbits) for o in row.ops] == [("h", [0], []), ("cx", [0, 1], []), ("measure", [0], [0]), ("measure", [1], [1])]


def test_registers_comments_definitions_guards(spark):
    row = parsed(spark, RICH).first()
    assert row.problem is None and row.num_qubits == 3
    assert [(o.op, o.params, o.qubits) for o in row.ops] == [("rz", ["pi/2"], [0]), ("h", [], [0]), ("h", [], [1]), ("barrier", [], [0, 1, 2]), ("x", [], [2]), ("cx", [], [1, 2]), ("measure", [], [2])]


@pytest.mark.parametrize("text, problem", [
    (None, "blank"), ("  \n", "blank"), ("qreg q[1];", "no_header"), ("OPENQASM 2.0;", "no_qubits"), ("OPENQASM 2.0; qreg q[1]; h r[0];", "unknown_argument"),
    ("OPENQASM 2.0; qreg q[1]; h q[1];", "unknown_argument"), ("OPENQASM 2.0; qreg q[2]; cx q[0],q[0];", "unknown_argument"), ("OPENQASM 2.0; qreg q[1]; %%;", "bad_statement")])
def test_bad_text(spark, text, problem):
    assert parsed(spark, text).first().problem == problem


def test_strict_reading_fails(spark):
    rows = spark.createDataFrame([("bad", "qreg q[1];")], "name string, qasm string")
    with pytest.raises(Exception, match="no_header"):
        readers.parse_circuits(rows).collect()


def test_features_of_bell(spark):
    f = qasm.features(parsed(spark, BELL)).first()
    assert (f["depth"], f["size"]) == (3, 4)
    assert (f.program_communication, f.critical_depth, f.entanglement_ratio) == (1.0, 1.0, 0.5)
    assert f.liveness == pytest.approx(5 / 6) and f.parallelism == 0.0


def test_barrier_joins_wires_without_depth(spark):
    head = "OPENQASM 2.0; qreg q[2];"
    rows = qasm.features(parsed(spark, head + "h q[0]; h q[0]; x q[1];", head + "h q[0]; h q[0]; barrier q; x q[1];")).orderBy("name").collect()
    assert [r["depth"] for r in rows] == [2, 3]


def test_critical_depth_takes_path_with_most_pairs(spark):
    text = "OPENQASM 2.0; qreg q[4]; h q[0]; h q[0]; cx q[2],q[3]; cx q[2],q[3];"
    assert qasm.features(parsed(spark, text)).first().critical_depth == 1.0


def depth_by_hand(ops, wires):
    level = [0] * wires
    for o in ops:
        used = list(o.qubits) + [wires // 2 + c for c in o.clbits]
        top = max((level[w] for w in used), default=0) + (o.op != "barrier")
        for w in used:
            level[w] = top
    return max(level)


def test_depth_against_plain_loop(spark):
    import random

    random.seed(3)
    texts = []
    for _ in range(30):
        body = []
        for _ in range(random.randint(1, 25)):
            a, b = random.sample(range(5), 2)
            body.append(random.choice([f"h q[{a}];", f"cx q[{a}],q[{b}];", "barrier q;", f"measure q[{a}] -> c[{b}];"]))
        texts.append("OPENQASM 2.0; qreg q[5]; creg c[5];" + "".join(body))
    for row in qasm.features(parsed(spark, *texts)).collect():
        assert row["depth"] == depth_by_hand(row.ops, 10)


def test_counts_summary_and_text_round_trip(spark):
    rows = parsed(spark, RICH)
    assert {r.op: r.n for r in qasm.op_counts(rows).collect()} == {"rz": 1, "h": 2, "barrier": 1, "x": 1, "cx": 1, "measure": 1}
    s = qasm.summary(rows).select("size", F.map_keys("op_counts").alias("ops")).first()
    assert s.ops == ["barrier", "cx", "h", "measure", "rz", "x"] and s["size"] == 6
    wide = qasm.gate_count_features(rows, ["h", "u3"]).first()
    assert (wide.gate_count_h, wide.gate_count_u3) == (2, 0)
    again = qasm.parse(rows.select("name", qasm.to_text(F.col("ops"), F.col("num_qubits"), F.col("num_clbits")).alias("qasm"), F.col("ops").alias("before"))).first()
    assert again.problem is None and again.ops == again.before


def test_verification_and_scores(spark):
    devices = spark.createDataFrame([("line", 3, ["h", "cx", "measure"], False, 0), ("full", 3, ["h", "cx", "measure"], True, 1), ("bare", 3, ["h"], False, 2)],
                                    "device_id string, num_qubits int, operation_names array<string>, all_to_all boolean, device_pos int")
    edges = spark.createDataFrame([("line", 1, 0)], "device_id string, src int, dst int")
    rows = parsed(spark, BELL).crossJoin(spark.createDataFrame([("line",), ("full",), ("bare",), ("none",)], "device string"))
    got = {r.device: (r.unsupported, r.fits_coupling, r.executable) for r in qasm.verify_compiled(rows, devices, edges).collect()}
    assert got == {"line": ([], True, True), "full": ([], True, True), "bare": (["cx", "measure"], False, False), "none": (["cx", "h", "measure"], False, False)}
    assert not {r.device: r.executable for r in qasm.verify_compiled(rows, devices, edges, directed=True).collect()}["line"]
    inst = spark.createDataFrame([("line", "h", [0], 0.1), ("line", "cx", [0, 1], 0.2), ("line", "measure", [0], 0.0), ("line", "measure", [1], 0.5)],
                                 "device_id string, name string, qubits array<int>, error double")
    score = {r.device: r.score for r in qasm.expected_fidelity(rows.where("device in ('line', 'bare')"), inst).collect()}
    assert score["line"] == pytest.approx(0.36) and score["bare"] is None
    arity = spark.createDataFrame([("a", "cx", 2), ("a", "barrier", 3), ("b", "ccx", 3)], "device_id string, name string, num_qubits int")
    assert {r.device_id: r.limit for r in qasm.synthesis_limit(arity).collect()} == {"a": 2, "b": 3}


def test_directory_archive_and_compiled_names(spark, tmp_path):
    import zipfile

    (tmp_path / "src").mkdir()
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("in/bell.qasm", BELL)
        z.writestr("readme.txt", "no circuit")
    got = readers.circuits_or_archive(spark, str(tmp_path / "src"), str(tmp_path / "all.zip")).collect()
    assert [(r.name, r.qasm) for r in got] == [("bell", BELL)]
    (tmp_path / "src" / "own.qasm").write_text(BELL)
    assert [r.name for r in readers.circuits_or_archive(spark, str(tmp_path / "src"), str(tmp_path / "all.zip")).collect()] == ["own"]
    (tmp_path / "src" / "a_b_expected_fidelity-dev_1.qasm").write_text(BELL)
    got = readers.scan_compiled(spark, str(tmp_path / "src")).first()
    assert (got.circuit, got.metric, got.device) == ("a_b", "expected_fidelity", "dev_1")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../x.qasm", BELL)
    with pytest.raises(Exception, match="unsafe member"):
        readers.scan_archive(spark, str(tmp_path / "bad.zip")).collect()


def test_nested_parentheses(spark):
    deep = "(" * 7 + "1" + ")" * 7
    text = f'OPENQASM 2.0; qreg q[1]; creg c[1]; rz(sin(pi/(2+1))) q[0]; u3(0.1,(1+2)*3,max(1,(2))) q[0]; if (c==1) rz(-(pi)) q[0]; rz(2*{deep}) q[0]; x q[0];'
    ops = qasm.parse(spark.createDataFrame([("a", text)], "name string, qasm string")).first()
    assert ops.problem is None
    assert [o.params for o in ops.ops] == [["sin(pi/(2+1))"], ["0.1", "(1+2)*3", "max(1,(2))"], ["-(pi)"], [f"2*{deep}"], []]
    long = 'OPENQASM 2.0; qreg q[1]; rz(' + "+".join(["(1)"] * 20_000) + ") q[0];"
    assert qasm.parse(spark.createDataFrame([("a", long)], "name string, qasm string")).first().problem is None


HEAD = 'OPENQASM 2.0; include "qelib1.inc"; qreg q[3]; qreg r[2]; creg c[3]; '
REFUSED = {
    "x q[i];": "unknown_argument", "x q[-1];": "unknown_argument", "x q[];": "unknown_argument", "x q[1234567];": "unknown_argument", "x q[99999999999999999999];": "unknown_argument",
    "cx q[0];": "wrong_arity", "h q[0],q[1];": "wrong_arity", "foo q[0];": "unknown_gate", "rz q[0];": "wrong_arity", "h(pi) q[0];": "wrong_arity", "cx q,r;": "size_mismatch",
    "measure q -> r;": "unknown_argument", "measure q[0] -> q[1];": "unknown_argument", "measure c[0] -> c[1];": "unknown_argument", "measure r -> c;": "size_mismatch",
    "measure q[0];": "wrong_arity", "measure q[0],c[0];": "bad_statement", "measure q -> c -> c;": "bad_statement", "x c[0];": "unknown_argument", "x s[0]; qreg s[1];": "unknown_argument",
    "barrier;": "wrong_arity", "barrier c;": "unknown_argument", "barrier q,q[0];": "unknown_argument", "reset c[0];": "unknown_argument", "x;": "wrong_arity", "x q[0],;": "wrong_arity",
    "rz(2+) q[0];": "bad_parameter", "rz(1,2) q[0];": "wrong_arity", "rz((1) q[0];": "bad_parameter", "rz(1)+(2) q[0];": "bad_parameter", "rz() q[0];": "wrong_arity",
    "qreg q[1];": "duplicate_name", "creg q[1];": "duplicate_name", "qreg t[0];": "bad_statement", "qreg t;": "bad_statement", "x q[0]": "bad_statement", "x q[0]; }": "bad_statement",
    "if (d==1) x q[0];": "unknown_argument", "if (q==1) x q[0];": "unknown_argument", "if (c=1) x q[0];": "bad_statement", "x -> q[0];": "unknown_argument",
    "gate g a { h b; }": "bad_definition", "gate g a { foo a; }": "bad_definition", "gate g a { g a; }": "bad_definition", "gate g a { cx a,a; }": "bad_definition",
    "gate g(t) a { rz(u) a; }": "bad_definition", "gate g a,a { }": "bad_definition", "gate g a { } gate g a { }": "bad_definition", "gate g a { x a; } g q[0],q[1];": "wrong_arity",
    "g q[0]; gate g a { x a; }": "unknown_gate", "opaque g a { x a; }": "bad_definition"}
ACCEPTED = ["cx q[0],q[1];", "cx q[0],q;".replace("q;", "r;"), "cx r,r;".replace("r,r", "r[0],r[1]"), "measure q -> c;", "measure q[1]->c[2];", "barrier q,r[0];", "if(c==5)x r;", "u3(0.1,-pi/2,2*pi) q;",
            "gate g(t,u) a,b { rz(t+u) a; cx a,b; barrier a,b; } g(1,2) q[0],r;", "opaque o(t) a; o(1) q;", "rz(2*theta) q[0];", "reset q;", "CX q[0],q[1]; U(0,0,pi) r;", "x\tq [ 0 ]\n;", ""]


def test_what_the_grammar_refuses(spark):
    rows = [(k, HEAD + k) for k in REFUSED]
    got = {r.name: r.problem for r in qasm.parse(spark.createDataFrame(rows, "name string, qasm string")).collect()}
    assert got == REFUSED


def test_what_the_grammar_accepts(spark):
    rows = [(k, HEAD + k) for k in ACCEPTED]
    assert {r.name: r.problem for r in qasm.parse(spark.createDataFrame(rows, "name string, qasm string")).collect()} == dict.fromkeys(ACCEPTED)


def test_first_problem_by_place_in_the_text(spark):
    rows = parsed(spark, HEAD + "cx q[0]; foo q[0];", HEAD + "foo q[0]; cx q[0];", HEAD + "gate g a { h b; } foo q[0];")
    assert [r.problem for r in rows.orderBy("name").collect()] == ["wrong_arity", "unknown_gate", "bad_definition"]


def plain_value(text):
    """A recursive descent parser: sums of products of signed powers."""
    import math
    import re

    tokens = re.findall(r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[A-Za-z_]\w*|\S", text) + [""]
    at = 0

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def total():
        x = product()
        while tokens[at] in "+-" and tokens[at]:
            x = x + product() if take() == "+" else x - product()
        return x

    def product():
        x = signed()
        while tokens[at] in "*/" and tokens[at]:
            x = x * signed() if take() == "*" else x / signed()
        return x

    def signed():
        if tokens[at] in ("-", "+"):
            return -signed() if take() == "-" else signed()
        x = atom()
        return x ** signed() if tokens[at] == "^" and take() else x

    def atom():
        t = take()
        if t == "(":
            x = total()
            assert take() == ")"
            return x
        if t == "pi":
            return math.pi
        if t in ("sin", "cos", "tan", "exp", "ln", "sqrt"):
            assert take() == "("
            x = total()
            assert take() == ")"
            return {"ln": math.log}.get(t, getattr(math, t, None))(x)
        return float(t)

    return total()


def test_values_of_expressions(spark):
    import math
    import random

    rng = random.Random(11)

    def some(depth):
        kind = rng.randrange(9 if depth else 3)
        if kind < 3:
            return rng.choice(["pi", "2", "0.5", "3e-1", ".25", "7", "1.", "1E1"])
        if kind == 3:
            return f"({some(depth - 1)})"
        if kind == 4:
            return rng.choice(["-", "+", "--"]) + some(depth - 1)
        if kind == 5:
            return f"{rng.choice(['sin', 'cos', 'exp'])} ({some(depth - 1)})"
        return some(depth - 1) + rng.choice([" + ", "-", "*", " / ", "^"]) + some(depth - 1)

    texts = {"pi/2", "1.5707963267948966", "-pi/4", "2^3^2", "-2^2", "2^-1", "2^-3*4", "8/4/2", "1-2-3", "-(-(1))", "((((((((((((1))))))))))))+1", "sqrt(2)*ln(10)"} | {some(4) for _ in range(300)}
    rows = spark.createDataFrame([(t,) for t in sorted(texts)], "e string").select("e", expressions.evaluate(F.col("e")).alias("r")).collect()
    checked = 0
    for row in rows:
        try:
            want = plain_value(row.e)
        except (OverflowError, ZeroDivisionError):
            want = None
        if isinstance(want, complex) or want is not None and not math.isfinite(want):
            want = None
        assert row.r.valid, row.e
        assert row.r.value == (None if want is None else pytest.approx(want, rel=1e-12)), row.e
        checked += want is not None
    assert checked > 200
    bad = ["", "1 2", "2+", "*2", "(", ")", "(1", "1)", "()", "(1)+(2))", "1)+(2", "sin", "sin(1,2)", "1,2", "1..2", "a b", "2 pi", "#", "1;2"]
    free = ["theta", "2*theta", "max(1,2)", "f(1)", "1/0", "ln(0)", "sqrt(-1)", "e"]
    got = {r.e: (r.valid, r.value) for r in spark.createDataFrame([(t,) for t in bad + free], "e string").select("e", expressions.evaluate(F.col("e")).alias("r")).select("e", "r.*").collect()}
    assert [t for t in bad if got[t][0]] == ["sin"] and all(got[t] == (True, None) for t in free)
    exact = spark.createDataFrame([("pi/2",), ("1.5707963267948966",)], "e string").select(expressions.value(F.col("e")).alias("v")).distinct().count()
    assert exact == 1


def test_deep_and_long_expressions(spark):
    deep = "(" * 300 + "pi" + ")" * 300
    many = "+".join(["1"] * 5000)
    rows = spark.createDataFrame([(deep,), (many,), ("-" * 51 + "1",)], "e string").select(expressions.value(F.col("e")).alias("v")).collect()
    assert [r.v for r in rows] == [pytest.approx(3.141592653589793), 5000.0, -1.0]


def test_definitions_expand_to_what_they_call(spark):
    text = HEAD + """gate half(t) a { rz(t/2) a; }
        gate pair(t,u) a,b { half(t+u) b; cx a,b; half(-t) a; barrier a,b; }
        opaque box(t) a;
        gate twice(t) a,b,d { pair(t,1) b,a; pair(2*t,pi) a,d; box(t) d; }
        twice(0.5) q[0],r[1],q[2]; pair(theta,1) q[1],r; h q[0]; measure q[0] -> c[1];"""
    rows = qasm.parse(spark.createDataFrame([("a", text)], "name string, qasm string"), definitions=True)
    opaque, found = rows.first(), qasm.expand_definitions(rows).first()
    assert opaque.problem is None and [o.op for o in opaque.ops] == ["twice", "pair", "pair", "h", "measure"]
    assert [(o.op, o.params, o.qubits, o.clbits) for o in found.ops] == [
        ("rz", ["(0.5+1)/2"], [0], []), ("cx", [], [4, 0], []), ("rz", ["(-0.5)/2"], [4], []), ("barrier", [], [4, 0], []),
        ("rz", ["((2*0.5)+pi)/2"], [2], []), ("cx", [], [0, 2], []), ("rz", ["(-(2*0.5))/2"], [0], []), ("barrier", [], [0, 2], []), ("box", ["0.5"], [2], []),
        ("rz", ["(theta+1)/2"], [3], []), ("cx", [], [1, 3], []), ("rz", ["(-theta)/2"], [1], []), ("barrier", [], [1, 3], []),
        ("rz", ["(theta+1)/2"], [4], []), ("cx", [], [1, 4], []), ("rz", ["(-theta)/2"], [1], []), ("barrier", [], [1, 4], []), ("h", [], [0], []), ("measure", [], [0], [1])]
    assert [o.pos for o in found.ops] == list(range(len(found.ops)))
    values = qasm.expand_definitions(rows).select(qasm.parameter_values().alias("v")).first().v
    assert values[0] == [0.75] and values[4] == [pytest.approx((1 + 3.141592653589793) / 2)] and values[9] == [None]
    plain = qasm.parse(spark.createDataFrame([("a", HEAD + "x q;"), ("b", None)], "name string, qasm string"), definitions=True)
    assert [[o.op for o in r.ops] for r in qasm.expand_definitions(plain).orderBy("name").collect()] == [["x"] * 3, []]


def plain_schedule(ops, timing, n):
    free, ended, idle = [0.0] * n, [None] * n, [0.0] * n
    for op, qubits in ops:
        begin = max(free[w] for w in qubits)
        end = begin + (0.0 if op == "barrier" else timing[op, tuple(qubits)])
        for w in qubits:
            free[w] = end
            if op != "barrier":
                idle[w] += begin - ended[w] if ended[w] is not None else 0.0
                ended[w] = end
    return max([e for e in ended if e is not None], default=0.0), idle


def test_success_probability_by_a_plain_schedule(spark):
    import math
    import random

    rng = random.Random(9)
    texts = []
    for _ in range(40):
        body = []
        for _ in range(rng.randint(1, 20)):
            a, b, c = rng.sample(range(4), 3)
            body.append(rng.choice([f"h q[{a}];", f"cx q[{a}],q[{b}];", "barrier q;", f"barrier q[{a}],q[{b}],q[{c}];", f"measure q[{a}] -> c[{b}];"]))
        texts.append("OPENQASM 2.0; qreg q[4]; creg c[4];" + "".join(body))
    error = {("h", (a,)): 0.001 * (a + 1) for a in range(4)} | {("measure", (a,)): 0.02 for a in range(4)} | {("cx", (a, b)): 0.01 * (a + 1) for a in range(4) for b in range(4) if a != b}
    timing = {k: 10.0 * len(k[0]) + 3 * k[1][0] for k in error}
    rows = [("d", name, list(q), error[name, q], timing[name, q]) for name, q in error]
    instructions = spark.createDataFrame(rows + rows[:3], "device_id string, name string, qubits array<int>, error double, duration_seconds double")
    qubits = spark.createDataFrame([("d", a, 500.0 + a, 520.0 - 9 * a) for a in range(4)], "device_id string, qubit int, t1 double, t2 double")
    circuits = parsed(spark, *texts).withColumn("device", F.lit("d"))
    want = {}
    for r in circuits.collect():
        length, idle = plain_schedule([(o.op, o.qubits) for o in r.ops], timing, 4)
        product = math.prod(1 - error[o.op, tuple(o.qubits)] for o in r.ops if o.op != "barrier")
        want[r.name] = (length, idle, product * math.exp(-sum(t / min(500.0 + a, 520.0 - 9 * a) for a, t in enumerate(idle))))
    got = {r.name: r for r in qasm.estimated_success_probability(circuits, instructions, qubits).collect()}
    assert got.keys() == want.keys() and any(sum(w[1]) for w in want.values())
    for name, (length, idle, score) in want.items():
        assert (got[name].length, got[name].idle) == (pytest.approx(length), pytest.approx(idle)) and got[name].score == pytest.approx(score)


def test_success_probability_of_what_is_unknown(spark):
    schema = "device_id string, name string, qubits array<int>, error double, duration_seconds double"
    head = "OPENQASM 2.0; qreg q[2]; creg c[2]; "
    circuits = parsed(spark, head + "h q[0]; cx q[0],q[1];", head + "h q[0]; h q[1]; h q[1]; cx q[0],q[1];", head + "x q[0];", head + "barrier q;", head).withColumn("device", F.lit("d"))
    instructions = spark.createDataFrame([("d", "h", [0], 0.5, 1.0), ("d", "h", [1], 0.0, 1.0), ("d", "cx", [0, 1], 0.0, 1.0)], schema)
    qubits = spark.createDataFrame([("d", 1, 1.0, 1.0)], "device_id string, qubit int, t1 double, t2 double")
    got = {r.name: (r.length, r.score) for r in qasm.estimated_success_probability(circuits, instructions, qubits).collect()}
    # n1 lets qubit 0 idle, of which nothing is known; n2 has an unknown gate; n4 no operation at all
    assert got == {"n0": (2.0, 0.5), "n1": (3.0, None), "n2": (None, None), "n3": (0.0, 1.0)}
    twice = instructions.union(spark.createDataFrame([("d", "h", [0], 0.75, 1.0)], schema))
    assert qasm.expected_fidelity(circuits.where("name = 'n0'"), twice).first().score == 0.25


def test_distinct_statements_are_parsed_once(spark):
    """Equal statements of many circuits make one row of the grammar's work; circuits with other declarations before them don't share it."""
    gates = [f"rz(pi/{k % 3}) q[{k % 2}];" for k in range(50)]
    rows = [(f"n{k}", HEAD + g) for k, g in enumerate(gates)] + [("again", HEAD + gates[0]), ("before", "OPENQASM 2.0; x q[0]; qreg q[2];"), ("wide", "OPENQASM 2.0; qreg r[3]; qreg q[2]; " + gates[0])]
    seen, parse_pieces = [], qasm._parse_pieces
    qasm._parse_pieces = lambda pieces: seen.append(pieces) or parse_pieces(pieces)
    try:
        got = {r.name: r for r in qasm.parse(spark.createDataFrame(rows, "name string, qasm string")).collect()}
    finally:
        qasm._parse_pieces = parse_pieces
    assert len(got) == len(rows) and seen[0].count() < 20
    assert got["again"].ops == got["n0"].ops and got["before"].problem == "unknown_argument" and got["wide"].ops[0].qubits == [3]


def test_summaries_read_their_circuits_once(spark):
    """Rows of one key count together, rows without a key count nothing; neither the summary nor the gate counts join the circuits to themselves."""
    schema = "name string, num_qubits int, num_clbits int, ops array<struct<pos:int,op:string,params:array<string>,qubits:array<int>,clbits:array<int>>>"
    x, h = (0, "x", [], [0], []), (1, "h", ["t"], [1], [])
    rows = spark.createDataFrame([("a", 2, 0, [x, h]), ("a", 3, 0, [x]), ("b", 1, 0, []), (None, 2, 0, [h])], schema)
    found = qasm.summary(rows)
    assert sorted(((r.name or "", r.num_qubits, r.size, r.num_parameters, r.op_counts) for r in found.collect()), key=str) == sorted(
        [("a", 2, 2, 1, {"h": 1, "x": 2}), ("a", 3, 1, 0, {"h": 1, "x": 2}), ("b", 1, 0, 0, None), ("", 2, 1, 1, None)], key=str)
    gates = qasm.gate_count_features(rows, ["x", "h"])
    assert sorted((r.name or "", r.gate_count_x, r.gate_count_h) for r in gates.collect()) == [("", 0, 0), ("a", 2, 1), ("a", 2, 1), ("b", 0, 0)]
    for table in (found, gates):
        assert "Join" not in table._jdf.queryExecution().optimizedPlan().toString()


def test_few_statements_are_looked_up_without_a_shuffle(spark, monkeypatch):
    texts = [None, "", "OPENQASM 2.0;", BELL, RICH, RICH + "foo a[0]; x a[7];", "x q[0];", BELL + "qreg z[2]; cx q,z; gate later u { x u; } later z;", BELL.replace("h q[0];", "rz(1/3*theta,2) q[0]; u1(1/3) q[1];")]
    rows = spark.createDataFrame([(k % 5, t) for k, t in enumerate(texts + texts)], "name int, qasm string")
    both = []
    for most in (qasm.MAX_SENT, 0):
        monkeypatch.setattr(qasm, "MAX_SENT", most)
        found = qasm.parse(rows, definitions=True, expand=True, values=True)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert ("Join" in plan, "Aggregate" in plan) == (most == 0, most == 0)
        both.append(sorted(found.drop("file").collect(), key=str))
    assert both[0] == both[1] and len(both[0]) == 18
    each = {r.qasm: (r.num_qubits, r.num_clbits, r.problem) for r in qasm.parse_each(rows).collect()}
    assert {r.qasm: (r.num_qubits, r.num_clbits, r.problem) for r in both[0]} == each


def test_statements_that_stand_for_much_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(qasm, "MAX_MEANING", 300)
    found = qasm.parse(spark.createDataFrame([("a", "OPENQASM 2.0; qreg q[40]; h q;")], "name string, qasm string"))
    assert "Join" in found._jdf.queryExecution().optimizedPlan().toString() and len(found.first().ops) == 40


def test_expressions_are_evaluated_once_each(spark, monkeypatch):
    texts = ["pi/2", "2*theta", "1/0", "1+", "", None, " 3 ", "pi/2"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    want = {r.k: (r.e.value, r.e.valid) for r in rows.select("k", expressions.evaluate(F.col("t")).alias("e")).collect()}
    for most in (expressions.MAX_SENT, 3):
        monkeypatch.setattr(expressions, "MAX_SENT", most)
        assert {r.k: (r.value, r.valid) for r in expressions.evaluated(rows, "t").collect()} == want


def test_declarations_are_hashed_once_for_a_text(spark):
    texts = [HEAD + "x q[0]; h q[1];", "OPENQASM 2.0; x q[0]; qreg q[2]; h q; creg c[1]; measure q[0] -> c[0]; gate g a { x a; } g q[1]; qreg r[1]; x r;", "OPENQASM 2.0; qreg q[1];", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "qasm string")
    found = qasm.parse(rows)
    columns = ["qasm", "num_qubits", "num_clbits", "ops", "problem"]
    assert sorted(found.select(columns).collect(), key=lambda r: r.qasm) == sorted(qasm.parse_each(rows).select(columns).collect(), key=lambda r: r.qasm)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # by one hash of the declarations, not one in each statement, and operations have their type without a cast of each
    assert plan.count("xxhash64(__context") == 1 and "xxhash64(1" not in plan and "cast(transform(" not in plan
