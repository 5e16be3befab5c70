"""Queries over the driver's tables: each shows an operator on data of the same shape, with SQL to hold it against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions import scalars as S
from .operators import compatibility, devices as D, expressions as E, jobs as J, qasm as Q, records as R, retrieval, sampling, scores as C, validation

#: The three candidate devices and their qubits.
DEVICES = (("ibm_falcon_127", 127), ("ibm_falcon_27", 27), ("quantinuum_h2_56", 56))
_DEVICES_SQL = ", ".join(f"('{name}', {n}, {k})" for k, (name, n) in enumerate(DEVICES))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _devices(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_DEVICES_SQL} AS t(device_id, num_qubits, device_pos)")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as candidate cells of their order: position by line, part and supplier, score the price."""
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("circuit"), F.format_string("%d:%d:%d", "l_linenumber", "l_partkey", "l_suppkey").alias("device"),
        (F.col("l_linenumber") * F.lit(10**15) + F.col("l_partkey") * F.lit(10**7) + F.col("l_suppkey")).alias("device_pos"), F.col("l_extendedprice").alias("score"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: one key for each user, views as the records of running work."""
    e = _table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("line_no"), F.col("event_type").alias("status"),
                    (F.col("event_id") % 4).alias("attempt"), F.col("value").alias("duration_seconds"))


def best_device_label(spark, sf_dir):
    return C.best_device(_lines(spark, sf_dir))


def rank_margin(spark, sf_dir):
    return C.selection_margin(_lines(spark, sf_dir))


def width_filter(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.col("p_size").alias("num_qubits"))
    catalog = _devices(spark).select("device_id", F.col("num_qubits").alias("device_qubits"))
    return J.fitting_pairs(parts, catalog).select("name", "device_id", "num_qubits")


def build_jobs(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").alias("num_qubits"))
    return J.build_jobs(parts, _devices(spark), "expected_fidelity", "circuits", "compiled")


def width_reasons(spark, sf_dir):
    r = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), F.col("p_size").alias("num_qubits"),
                                             F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("ibm_falcon_27"), F.lit("other_device"))).alias("allowed_devices"))
    known = compatibility.classify(r, _devices(spark)).select("request_id", "device_id", F.array_join("reasons", ",").alias("reasons"))
    return known.union(compatibility.unknown_devices(r, _devices(spark)).select("request_id", "device_id", F.array_join("reasons", ",")))


def compatibility_report(spark, sf_dir):
    r = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), F.col("p_size").alias("num_qubits"), F.lit(None).cast("array<string>").alias("allowed_devices"))
    out = compatibility.report(r, _devices(spark))
    return out.select("request_id", F.array_join("available", ",").alias("available"), F.array_join(F.map_keys("unavailable"), ",").alias("unavailable"))


def latest_by_key(spark, sf_dir):
    return J.latest_records(_log(spark, sf_dir), running="view").select("key", "line_no", "status", "duration_seconds")


def attempts_status(spark, sf_dir):
    return J.attempts_and_status(_log(spark, sf_dir))


def mean_duration(spark, sf_dir):
    return J.mean_duration(_log(spark, sf_dir)).select(F.round("mean_seconds", 6).alias("mean_seconds"), "n")


def finite_stats(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("x"))
    return D.number_summary(rows, ["l_returnflag"], "x").withColumn("mean", F.round("mean", 9))


def seeded_cap(spark, sf_dir):
    return sampling.cap_classes(_table(spark, sf_dir, "labels"), "quality", "doc_id", 3.0, seed=7).select("doc_id", "quality")


def seeded_top(spark, sf_dir):
    return sampling.cap_rows(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 50, seed=7)


def stratified_split(spark, sf_dir):
    return sampling.stratified_split(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id")


def balanced_weights(spark, sf_dir):
    out = sampling.balanced_weights(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality")
    return out.select("doc_id", "quality", F.round("weight", 9).alias("weight"))


def record_ids(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", S.record_id(F.lit("expected_fidelity"), F.col("doc_id").cast("string"), F.col("text")).alias("record_id"))


def nearest_rows(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    first = e.where("vec_id = 0").select("embedding").first()
    query = first[0] if first and first[0] else []
    found = retrieval.nearest_rows(e, F.array(*[F.lit(float(x)) for x in query]), "embedding", "vec_id", 5 if query else 0)
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


def nearest_rows_each(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    found = retrieval.nearest_rows_each(e.where("vec_id % 20 = 0"), e, "embedding", "vec_id", 5)
    return found.select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


def op_counts(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([a-z]+)"))).alias("op"))
    return d.groupBy("doc_id", "op").agg(F.count("*").alias("n"))


def unsupported_ops(spark, sf_dir):
    used = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("used"))
    return used.select("l_orderkey", F.array_join(S.sorted_difference(F.col("used"), F.array(F.lit("AF"), F.lit("NO"))), ",").alias("unsupported"))


def json_field(spark, sf_dir):
    v = F.try_parse_json("props")
    e = _table(spark, sf_dir, "events").select("event_id", v.alias("v"))
    return e.select("event_id", F.coalesce(S.int_field(F.col("v"), "$.k"), F.lit(-1)).alias("k"), S.is_object(F.col("v")).alias("is_object"))


def coverage(spark, sf_dir):
    jobs = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("circuit"))
    valid = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    return J.coverage(jobs, valid)


def pending(spark, sf_dir):
    jobs = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    valid = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key")).distinct()
    attempts = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("attempts"))
    return J.pending_jobs(jobs, valid, attempts, 4)


def missing_by_device(spark, sf_dir):
    jobs = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("device"))
    valid = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key")).distinct()
    return J.missing_by_device(jobs, valid)


def device_queues(spark, sf_dir):
    jobs = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("device"),
                                                  (F.col("o_custkey") % 5).alias("num_qubits"), F.col("o_orderkey").alias("circuit"))
    return J.device_queues(jobs)


def reason_examples(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("idx"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("reason"))
    return R.rejection_report(o, "reason", "o_orderkey", "idx").select("reason", "n", F.array_join("examples", ",").alias("examples"))


def fidelity_product(spark, sf_dir):
    f = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(1 - F.col("l_discount")).alias("f"))
    return f.select("l_orderkey", S.sorted_product(F.col("f")).alias("fidelity"))


def label_counts(spark, sf_dir):
    return C.label_distribution(_table(spark, sf_dir, "documents").select(F.col("lang").alias("label")))


def below_minimum(spark, sf_dir):
    labels = _table(spark, sf_dir, "documents").select(F.col("lang").alias("label"))
    wanted = spark.sql("SELECT * FROM VALUES ('en'), ('de'), ('es'), ('it') AS t(device_id)")
    return C.below_minimum(wanted, labels, 120)


def failure_counts(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("circuit"), F.when(F.col("l_returnflag") == "R", F.lit(-1.0)).otherwise(F.col("l_extendedprice")).alias("score"))
    return C.failure_counts(rows)


def first_circuits(spark, sf_dir):
    jobs = _table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("num_qubits"), F.col("l_orderkey").alias("circuit"), F.col("l_suppkey").alias("device"))
    return J.first_circuits(jobs, 40)


def one_job_per_device(spark, sf_dir):
    jobs = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("device"), (F.col("o_custkey") % 5).alias("num_qubits"), F.col("o_orderkey").alias("circuit"))
    return J.one_job_per_device(jobs)


def copy_plan(spark, sf_dir):
    from .sources import writers

    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("sha256"), "doc_id")
    # every document is on both sides; at the target some have another name and some another content
    target = d.select(F.when(F.col("doc_id") % 3 == 0, F.concat("name", F.lit("-moved"))).otherwise(F.col("name")).alias("name"),
                      F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("sha256")).alias("sha256"))
    return writers.copy_plan(d, target)


def validate_plans(spark, sf_dir):
    """Responses made from lines; the part's key says which of the rules is broken, besides level, device, layout and evidence."""
    q, k = F.col("l_quantity").cast("int"), F.col("l_partkey") % 17
    device = F.when(F.col("l_returnflag") == "R", F.lit("unknown")).otherwise(F.lit("ibm_falcon_27"))
    plan = F.struct((q % 6).alias("optimization_level"), F.when(k == 4, -1).otherwise(F.col("l_partkey")).alias("seed_transpiler"), F.when(q % 7 == 0, F.lit("other")).alias("layout_method"),
                    F.when(k == 5, F.lit("teleport")).when(k == 6, F.lit("sabre")).alias("routing_method"))
    response = F.to_json(F.struct(
        device.alias("selected_device"), F.when(k == 1, "other").otherwise("expected_fidelity").alias("figure_of_merit"), F.when(k == 2, "other").otherwise("qiskit").alias("compiler"),
        F.when(k != 3, plan).alias("qiskit_plan"), F.when(k == 7, "  ").when(k != 8, "because").alias("explanation"),
        F.when(k == 9, F.array(F.lit("ok"), F.lit(" "))).when(F.col("l_linestatus") == "F", F.array(F.lit("score"))).alias("evidence"),
        F.when(k == 10, F.array(F.lit(""))).when(k == 11, F.array(F.lit("w"))).alias("warnings")))
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(k == 0, "[1]").otherwise(response).alias("response"),
                                                    F.array(F.lit("ibm_falcon_27")).alias("available"), F.lit("expected_fidelity").alias("figure_of_merit"),
                                                    F.lit('{"max_optimization_level": 2}').alias("constraints"))
    out = validation.validate(rows)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.size("errors").alias("n_errors"), F.array_join("errors", "; ").alias("errors"), "is_valid")


def _text(form: str, *numbers):
    """``format_string`` for whole numbers, without Java's formatter, which takes longer than the rest of a line's circuit."""
    parts = form.split("%d")
    shown = [F.coalesce(n.cast("string"), F.lit("null")) for n in numbers]
    return F.concat(*[c for part, n in zip(parts, [*shown, None]) for c in (F.lit(part), n) if c is not None])


#: Wires of the circuits that stand for orders.
_WIRES = 5


def _circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as circuits of five qubits: a gate for each line, by line, part and supplier; returned lines couple two qubits, accepted
    ones turn one by a nested expression, open ones measure."""
    a = (F.col("l_partkey") % _WIRES).cast("int")
    b = ((a + 1 + F.col("l_suppkey") % (_WIRES - 1)) % _WIRES).cast("int")
    gate = F.when(F.col("l_returnflag") == "R", _text("cx q[%d],q[%d];", a, b)).when(
        F.col("l_returnflag") == "A", _text("rz(pi/(%d+(1))) q[%d];", F.col("l_linenumber"), a)).otherwise(_text("measure q[%d] -> c[%d];", a, a))
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.struct("l_linenumber", "l_partkey", "l_suppkey", gate.alias("gate")).alias("g"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("g")), lambda g: g["gate"]), "\n")
    head = F.lit(f'OPENQASM 2.0;\ninclude "qelib1.inc";\nqreg q[{_WIRES}];\ncreg c[{_WIRES}];\n')
    return lines.groupBy("name").agg(F.concat(head, text, F.lit("\n")).alias("qasm"))


def _catalog(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Devices, their edges and their instructions with errors."""
    devices = spark.sql("""SELECT * FROM VALUES ('ring', 5, array('cx', 'rz', 'measure'), false, 0), ('full', 5, array('cx', 'measure'), true, 1)
        AS t(device_id, num_qubits, operation_names, all_to_all, device_pos)""")
    edges = spark.sql("SELECT 'ring' AS device_id, CAST(id AS INT) AS src, CAST((id + 1) % 5 AS INT) AS dst FROM range(5)")
    one = spark.sql("""SELECT d.device_id, name, array(CAST(id AS INT)) AS qubits, 0.001D * (1 + id) AS error
        FROM range(5), (VALUES ('ring'), ('full')) AS d(device_id), (VALUES ('rz'), ('measure')) AS n(name)""")
    two = spark.sql("""SELECT 'full' AS device_id, 'cx' AS name, array(CAST(a.id AS INT), CAST(b.id AS INT)) AS qubits, 0.01D * (1 + a.id) AS error
        FROM range(5) a JOIN range(5) b ON a.id <> b.id WHERE a.id < 4""")
    return devices, edges, one.union(two)


def _wires_text(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",")


def circuit_operations(spark, sf_dir):
    found = Q.explode_ops(Q.parse(_circuits(spark, sf_dir)))
    return found.select("name", "pos", "op", F.array_join("params", "|").alias("params"), _wires_text("qubits").alias("qubits"), _wires_text("clbits").alias("clbits"))


def circuit_problems(spark, sf_dir):
    """Circuits with what is wrong in them: by key, no header, a wire that is not there, no text, a register missing."""
    k = F.col("name") % 5
    broken = F.when(k == 0, F.regexp_replace("qasm", "OPENQASM 2.0;", "")).when(k == 1, F.concat("qasm", F.lit("x q[9];"))).when(k == 2, F.lit(" ")).when(
        k == 3, F.regexp_replace("qasm", r"qreg q\[\d\];", "")).otherwise(F.col("qasm"))
    return Q.parse(_circuits(spark, sf_dir).withColumn("qasm", broken)).select("name", "problem")


def circuit_op_counts(spark, sf_dir):
    return Q.op_counts(Q.parse(_circuits(spark, sf_dir)))


def circuit_features(spark, sf_dir):
    found = Q.features(Q.parse(_circuits(spark, sf_dir)))
    return found.select("name", "depth", "size", *[F.round(c, 9).alias(c) for c in ("program_communication", "critical_depth", "entanglement_ratio", "parallelism", "liveness")])


def circuit_gate_counts(spark, sf_dir):
    return Q.gate_count_features(Q.parse(_circuits(spark, sf_dir)), ["cx", "rz", "h"])


def circuit_summary(spark, sf_dir):
    found = Q.summary(Q.parse(_circuits(spark, sf_dir)))
    counts = F.array_join(F.transform(F.map_entries("op_counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return found.select("name", "num_qubits", "num_clbits", "depth", "size", counts.alias("op_counts"))


def circuit_text(spark, sf_dir):
    found = Q.parse(_circuits(spark, sf_dir))
    return found.select("name", Q.to_text(F.col("ops"), F.col("num_qubits"), F.col("num_clbits")).alias("text"))


def compiled_checks(spark, sf_dir):
    devices, edges, _ = _catalog(spark)
    pairs = Q.parse(_circuits(spark, sf_dir)).select("*", F.explode(F.array(F.lit("ring"), F.lit("full"), F.lit("unknown"))).alias("device"))
    found = Q.verify_compiled(pairs, devices, edges)
    return found.select("name", "device", F.array_join("unsupported", ",").alias("unsupported"), "native_basis", "fits_coupling", "executable")


def compiled_fidelity(spark, sf_dir):
    pairs = Q.parse(_circuits(spark, sf_dir)).withColumn("device", F.lit("full"))
    return Q.expected_fidelity(pairs, _catalog(spark)[2]).select("name", "device", F.round("score", 12).alias("score"))


def depth_scores(spark, sf_dir):
    return Q.critical_depth_score(Q.features(Q.parse(_circuits(spark, sf_dir)))).select("name", F.round("score", 9).alias("score"))


#: A definition, two registers of qubits and one of bits.
_TWO_REGISTERS = """OPENQASM 2.0;
include "qelib1.inc";
gate kick(t,u) x,y { rz(t/2) x; cx x,y; rz(-(u)) y; }
qreg a[3];
qreg b[2];
creg c[3];
"""


def _two_register_circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as circuits over two registers: a statement for each line, by its part a call of the definition, a barrier, a gate over a whole
    register, a pair, a measurement of a whole register or a gate of three parameters."""
    i, j, line, kind = F.col("l_partkey") % 3, F.col("l_suppkey") % 2, F.col("l_linenumber"), F.col("l_partkey") % 6
    gate = (F.when(kind == 0, _text("kick(%d,pi) a[%d],b[%d];", line, i, j)).when(kind == 1, _text("barrier a,b[%d];", j)).when(kind == 2, F.lit("h b;"))
            .when(kind == 3, _text("cx a[%d],b[%d];", i, j)).when(kind == 4, F.lit("measure a -> c;")).otherwise(_text("u3(pi/%d,0.5,-1) a[%d];", line, i)))
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.struct("l_linenumber", "l_partkey", "l_suppkey", gate.alias("gate")).alias("g"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("g")), lambda g: g["gate"]), "\n")
    return lines.groupBy("name").agg(F.concat(F.lit(_TWO_REGISTERS), text, F.lit("\n")).alias("qasm"))


def circuit_expansions(spark, sf_dir):
    """Every operation that definitions, whole registers and barriers stand for, with the values of its parameters."""
    found = Q.parse(_two_register_circuits(spark, sf_dir), expand=True, values=True)
    rows = found.select("name", "problem", F.explode_outer(F.arrays_zip("ops", "values")).alias("z")).where("z IS NOT NULL").select("name", "problem", "z.ops.*", "z.values")
    return rows.select("name", "pos", "op", _wires_text("qubits").alias("qubits"), _wires_text("clbits").alias("clbits"),
                       *[F.round(F.get("values", k), 9).alias(f"value_{k}") for k in range(3)], "problem")


def circuit_calls(spark, sf_dir):
    """Operations by name where definitions stay calls."""
    return Q.op_counts(Q.parse(_two_register_circuits(spark, sf_dir)))


#: A bad statement for each remainder of the key, and what is wrong with it.
_DEFECTS = [("x a[i];", "unknown_argument"), ("x a[-1];", "unknown_argument"), ("x a[];", "unknown_argument"), ("x a[1234567];", "unknown_argument"), ("cx a[0];", "wrong_arity"),
            ("h a[0],a[1];", "wrong_arity"), ("foo a[0];", "unknown_gate"), ("rz a[0];", "wrong_arity"), ("h(pi) a[0];", "wrong_arity"), ("cx a,b;", "size_mismatch"),
            ("measure a -> b;", "unknown_argument"), ("measure a[0] -> a[1];", "unknown_argument"), ("rz(2+) a[0];", "bad_parameter"), ("kick(1) a[0],b[0];", "wrong_arity"),
            ("gate kick a { x a; }", "bad_definition"), ("x a[0]", "bad_statement"), ("if (d==1) x a[0];", "unknown_argument"), ("qreg c[1];", "duplicate_name"), ("cx a[1],a[1];", "unknown_argument"), ("", None)]


def circuit_refusals(spark, sf_dir):
    """Circuits that end with one of the defects, and what the parser says of them."""
    text = F.element_at(F.array(*[F.lit(d) for d, _ in _DEFECTS]), (F.col("name") % len(_DEFECTS) + 1).cast("int"))
    return Q.parse(_two_register_circuits(spark, sf_dir).withColumn("qasm", F.concat("qasm", text))).select("name", "problem")


def parameter_values(spark, sf_dir):
    """Expressions from lines, by a precedence parser: powers, signs, functions, nested parentheses, free names."""
    n = {c: F.col(c).cast("int") for c in ("l_linenumber", "l_quantity")} | {"s": F.col("l_suppkey") % 7}
    line, quantity, s = n.values()
    text = (F.when(quantity % 4 == 0, _text("-pi/(%d+((%d)))*2^-%d", line, s, s)).when(quantity % 4 == 1, _text("sin(%d)^2+cos(%d)^2-%d*1e-1/-4", quantity, quantity, line))
            .when(quantity % 4 == 2, _text("sqrt(%d)-ln(%d)*(1-(2-(3-%d)))", quantity, line, s)).otherwise(_text("%d*theta", line)))
    found = E.evaluated(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("expression")), "expression")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("value", 9).alias("value"), "valid")


def success_probabilities(spark, sf_dir):
    """Circuits of two registers with definitions expanded, scheduled on a device whose pairs, bits and qubits all differ."""
    one = spark.sql("""SELECT 'five' AS device_id, name, array(CAST(id AS INT)) AS qubits, error * (1 + id) AS error, duration + id * step AS duration_seconds FROM range(5),
        (VALUES ('h', 0.001D, 30D, 0D), ('u3', 0.002D, 50D, 0D), ('rz', 0D, 0D, 0D), ('measure', 0.004D, 700D, 1D)) AS n(name, error, duration, step)""")
    two = spark.sql("""SELECT 'five' AS device_id, 'cx' AS name, array(CAST(a.id AS INT), CAST(b.id AS INT)) AS qubits, 0.01D * (1 + a.id) AS error, 200D + 10 * b.id AS duration_seconds
        FROM range(5) a JOIN range(5) b ON a.id <> b.id""")
    qubits = spark.sql("SELECT 'five' AS device_id, CAST(id AS INT) AS qubit, 50000D + 1000 * id AS t1, 47000D + 2000 * id AS t2 FROM range(5)")
    circuits = Q.parse(_two_register_circuits(spark, sf_dir), expand=True).withColumn("device", F.lit("five"))
    found = Q.estimated_success_probability(circuits, one.union(two), qubits)
    return found.select("name", F.round("length", 6).alias("length"), F.round(F.aggregate("idle", F.lit(0.0), lambda a, x: a + x), 6).alias("idle"), F.round("score", 9).alias("score"))


def circuit_groups(spark, sf_dir):
    """Circuits that differ in parameters only, by the operations they share."""
    return Q.parse(_circuits(spark, sf_dir)).select("name", Q.sequence_key().alias("sequence"))


def group_split(spark, sf_dir):
    """Orders dealt to sides by customer, so that no customer is on two."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return sampling.group_split(rows, "o_custkey", "o_orderpriority").select("o_orderkey", "o_custkey", "side")


def _choices(spark, sf_dir):
    """Lines as cells, returned ones failed; the cell of the highest discount against that of the highest tax."""
    lines = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("circuit"), F.format_string("%d:%d:%d", "l_linenumber", "l_partkey", "l_suppkey").alias("device"),
        F.when(F.col("l_returnflag") == "R", F.lit(-1.0)).otherwise(F.col("l_extendedprice")).alias("score"), "l_discount", "l_tax")
    by = lambda c: F.max_by("device", F.struct(c, "device"))
    return lines, lines.groupBy("circuit").agg(by("l_discount").alias("first"), by("l_tax").alias("second"))


def paired_outcomes(spark, sf_dir):
    found = C.paired_outcomes(*_choices(spark, sf_dir))
    return found.select("circuit", "outcome", *[F.round(c, 6).alias(c) for c in ("regret", "first_score", "second_score", "best_score")])


def paired_comparison(spark, sf_dir):
    return C.comparison(C.paired_outcomes(*_choices(spark, sf_dir))).withColumns({c: F.round(c, 4) for c in ("mean_regret", "max_regret")})


def confusion(spark, sf_dir):
    """Status of orders as a label, priority as what it was taken for."""
    found = C.confusion(_table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")
    return found.select(F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("predicted"), "n", F.round("share", 9).alias("share"))


def synthesis_limits(spark, sf_dir):
    operations = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("device_id"), F.when(F.col("l_returnflag") == "N", "barrier").otherwise("ccx").alias("name"),
                                                          F.when(F.col("l_quantity") == 3, 3).otherwise(2).alias("num_qubits"))
    return Q.synthesis_limit(operations)


def _records(spark, sf_dir):
    """Parts as past examples: size and price as features, three devices by key; some lack an input or a feature."""
    k = F.col("p_partkey")
    by_name = F.when(k % 11 == 0, F.create_map(F.lit("width"), F.col("p_size").cast("double"))).otherwise(
        F.create_map(F.lit("width"), F.col("p_size").cast("double"), F.lit("cost"), F.col("p_retailprice").cast("double")))
    backend = lambda name, n: F.struct(F.lit(name).alias("id"), F.lit(n).alias("num_qubits"), F.array(F.lit("cx")).alias("operation_names"))
    backends = F.when(k % 3 == 0, F.array(backend("a", 5), backend("b", 7))).otherwise(F.array(backend("c", 9)))
    content = F.struct(F.struct(F.when(k % 2 == 0, "expected_fidelity").otherwise("critical_depth").alias("name"), F.lit("maximize").alias("direction")).alias("objective"),
                       F.create_map(F.lit("max"), F.lit("1")).alias("user_constraints"),
                       F.struct(k.cast("string").alias("name"), F.lit("text").alias("qasm2"), F.create_map(F.lit("depth"), F.col("p_size").cast("string")).alias("summary"),
                                F.struct(by_name.alias("by_name")).alias("features")).alias("circuit"), backends.alias("compatible_backends"))
    return _table(spark, sf_dir, "part").select(k.alias("record_id"), F.when(k % 13 > 0, content).alias("input"))


def nearest_examples(spark, sf_dir):
    features = F.create_map(F.lit("width"), (F.col("s_suppkey") % 50).cast("double"), F.lit("cost"), (1000 + F.col("s_suppkey")).cast("double"))
    requests = _table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("request_id"), F.when(F.col("s_suppkey") % 2 == 0, "expected_fidelity").otherwise("critical_depth").alias("figure_of_merit"),
        features.alias("features"), F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c"), F.lit("x"))).alias("available"))
    found = retrieval.nearest_examples(requests, _records(spark, sf_dir), 3)
    return found.select("request_id", "rank", "record_id", F.round("distance", 9).alias("distance"), F.col("prompt_input.circuit.name").alias("shown_name"),
                        F.size("prompt_input.compatible_backends").alias("shown_backends"))


def trace_problems(spark, sf_dir):
    """Lines as compiled cells with each defect that a learned trace can have."""
    q = F.col("l_quantity").cast("int") % 7
    passes = F.when(q == 3, F.array().cast("array<string>")).when(q == 4, F.array(F.lit("fallback:x"), F.lit("terminate"))).when(q == 5, F.array(F.lit("p"))).otherwise(F.array(F.lit("p"), F.lit("terminate")))
    cell = F.struct(F.when(q == 1, "fallback").when(q == 6, F.lit(None)).otherwise("rl").alias("mode"), F.when(q == 2, "timeout").otherwise("success").alias("status"), passes.alias("passes"))
    cells = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linestatus") == "F", cell).alias("cell"))
    return cells.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.trace_problem(F.col("cell")).alias("problem"))


def strict_successes(spark, sf_dir):
    e = F.col("event_id")
    rows = _table(spark, sf_dir, "events").select(
        "event_id", F.when(e % 5 == 0, "success_recovered_after_timeout").when(e % 5 == 1, "timeout").otherwise("success").alias("status"),
        F.when(e % 3 == 0, "rl").when(e % 3 == 1, "fallback").alias("mode"), (e % 3 < 2).alias("has_mode"), (e % 6 == 2).alias("mode_is_null"),
        F.when(e % 7 == 0, "rl").alias("phase"), (e % 4 == 0).alias("has_fallback"))
    return rows.select("event_id", J.strict_success().alias("strict"))


def log_lines(spark, sf_dir):
    """Event properties as log lines: what is left out, and why."""
    from .sources import readers

    lines = _table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 4 == 0, F.col("props")).when(
        F.col("event_id") % 4 == 1, F.lit("{broken")).when(F.col("event_id") % 4 == 2, F.lit("[1]")).otherwise(F.lit('{"key": "a", "status": "success"}')).alias("value"))
    kept = readers.parse_manifest(lines).select("line_no", F.lit("kept").alias("reason"))
    return kept.union(readers.malformed_lines(lines).select("line_no", "reason"))


def cell_states(spark, sf_dir):
    mode, status = R.cell_state(F.col("l_quantity").cast("int"), F.lit(40), F.when(F.col("l_returnflag") == "R", F.lit("success")),
                                F.when(F.col("l_linenumber") == 1, F.lit("rl")), F.col("l_linestatus") == "F")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", mode.alias("mode"), status.alias("status"))


def instruction_summaries(spark, sf_dir):
    """Suppliers as devices, their lines as instructions: what is known of each operation."""
    rows = _table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("device_id"), F.col("l_returnflag").alias("name"), F.when(F.col("l_linenumber") == 1, F.lit(float("inf"))).otherwise(F.col("l_discount").cast("double")).alias("error"),
        F.when(F.col("l_linestatus") == "F", F.col("l_tax").cast("double")).alias("duration_seconds"))
    stat = lambda c: [F.col(f"{c}.count").alias(f"{c}_count"), F.col(f"{c}.min").alias(f"{c}_min"), F.round(f"{c}.mean", 9).alias(f"{c}_mean"), F.col(f"{c}.max").alias(f"{c}_max")]
    return D.instruction_summary(rows).select("device_id", "name", *stat("errors"), *stat("durations"))


def device_records(spark, sf_dir):
    """Suppliers as devices with their lines as edges and instructions: the nested record, its parts as text."""
    lines = _table(spark, sf_dir, "lineitem")
    wire, other = F.col("l_partkey") % 5, (F.col("l_partkey") + 1 + F.col("l_linenumber") % 4) % 5
    edges = lines.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("device_id"), wire.alias("src"), other.alias("dst"))
    instructions = lines.select(F.col("l_suppkey").alias("device_id"), F.col("l_returnflag").alias("name"), F.lit(1).alias("num_qubits"), F.array(wire).alias("qubits"),
                                F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(F.col("l_discount").cast("double")).alias("error"), F.lit(None).cast("double").alias("duration_seconds"))
    suppliers = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device_id"), F.lit(5).alias("num_qubits"), F.array(F.lit("R"), F.lit("A")).alias("operation_names"),
                                                         F.lit(False).alias("all_to_all"))
    r = D.device_record(suppliers, edges, instructions).select("device_id", "record.*")
    return r.select("device_id", F.array_join("operation_names", ",").alias("operation_names"), F.array_join(F.transform("edges", lambda e: F.concat_ws(">", e["src"], e["dst"])), ",").alias("edges"),
                    F.size("instructions").alias("n_instructions"), F.size(F.filter("instructions", lambda i: i["error"].isNull())).alias("n_unknown"),
                    F.array_join(F.map_keys("summaries"), ",").alias("summarised"))


def provenance(spark, sf_dir):
    return C.provenance(cell_states(spark, sf_dir))


def all_failed(spark, sf_dir):
    score = F.when(F.col("l_returnflag") == "R", F.lit(-1.0)).when(F.col("l_linestatus") == "F", F.lit(float("nan"))).otherwise(F.col("l_extendedprice").cast("double"))
    return C.all_failed(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("circuit"), score.alias("score")))


def _device_scores(spark, sf_dir):
    """The best line of each order on each of the three devices, which its line number deals; returned lines have failed."""
    price = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice").cast("double"))
    device = F.element_at(F.array(*[F.lit(name) for name, _ in DEVICES]), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return _table(spark, sf_dir, "lineitem").where("l_linenumber < 3").groupBy(F.col("l_orderkey").alias("circuit"), device.alias("device")).agg(F.max(price).alias("score"))


def dense_scores(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"))
    return C.dense_scores(orders, orders, _devices(spark), _device_scores(spark, sf_dir)).select("circuit", "device", "device_pos", "score")


def labelled_samples(spark, sf_dir):
    """Orders with a winner among the devices, with their features and the scores by device."""
    features = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("circuit"), F.create_map(F.lit("num_qubits"), (F.col("o_custkey") % 5).cast("double")).alias("features"))
    cells = _device_scores(spark, sf_dir).join(_devices(spark).select(F.col("device_id").alias("device"), "device_pos"), "device")
    out = C.labelled_samples(cells, features)
    return out.select("circuit", "label", F.col("features")["num_qubits"].alias("num_qubits"), F.array_join(F.map_keys("scores"), ",").alias("scored"))


def strict_keys(spark, sf_dir):
    """Users as jobs: those whose last event counts as a learned success and who have an order."""
    log = _log(spark, sf_dir).withColumns({"status": F.when(F.col("status") == "click", "success").otherwise(F.col("status")), "mode": F.when(F.col("line_no") % 3 == 0, "rl"), "phase": F.lit(None).cast("string"),
                                           "has_mode": F.col("line_no") % 3 < 2, "mode_is_null": F.col("line_no") % 6 == 1, "has_fallback": F.col("line_no") % 4 == 0})
    files = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct()
    return J.strict_keys(_log(spark, sf_dir).select("key").distinct(), J.latest_records(log, running="view"), files)


def changed_outputs(spark, sf_dir):
    """Orders as files: those that are new or differ from what an earlier listing says."""
    o, key = _table(spark, sf_dir, "orders"), F.col("o_orderkey")
    now = o.select(key.alias("key"), F.col("o_orderdate").alias("modified"), F.col("o_custkey").alias("size"), (F.col("o_orderstatus") != "P").alias("valid"))
    before = o.where(key % 7 != 0).select(key.alias("key"), F.col("o_orderdate").alias("modified"), F.when(key % 5 == 0, F.lit(0)).otherwise(F.col("o_custkey")).alias("size"))
    return J.changed_outputs(before, now)


def legacy_imports(spark, sf_dir):
    from .sources import writers

    jobs = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    own, old = (_table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("key")) for flag in "RA")
    return writers.legacy_imports(jobs, own, old)


def last_errors(spark, sf_dir):
    """Lines as attempts at their order: what the last one lacked, of orders that no attempt satisfied."""
    errors = F.when(F.col("l_quantity") > 45, F.array().cast("array<string>")).otherwise(F.array("l_returnflag", F.col("l_partkey").cast("string")))
    per = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("attempt")).agg(F.min_by(errors, F.struct("l_partkey", "l_suppkey")).alias("errors"))
    return J.last_errors(per).select("request_id", "attempts", F.array_join("errors", ",").alias("errors"))


def folds(spark, sf_dir):
    return sampling.fold_column(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", 5)


def balance_report(spark, sf_dir):
    return sampling.balance(_table(spark, sf_dir, "documents").select("doc_id", "lang").where("lang is not null"), "lang", "doc_id", "cap-ratio", 1.5, seed=3)[1]


def indexed_circuits(spark, sf_dir):
    from .plans import device_selector

    rows = _table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("circuit"), "o_custkey")
    return device_selector.with_index(rows, "circuit", "index")


def export_reasons(spark, sf_dir):
    """Orders as circuits and their lines as cells: why each is no example, and the label and margin of those that are."""
    from .plans import strict_export

    key = F.col("o_orderkey")
    circuits = _table(spark, sf_dir, "orders").select(
        key.cast("string").alias("name"), key.alias("idx"), F.when(key % 11 != 0, F.concat(F.lit("text of "), key.cast("string"))).alias("qasm"), (F.col("o_custkey") % 50).cast("int").alias("num_qubits"),
        F.create_map(F.when(key % 13 == 0, "width").otherwise("num_qubits"), F.when(key % 17 == 0, F.lit(float("inf"))).when(key % 19 == 0, F.lit(77.0)).otherwise((F.col("o_custkey") % 50).cast("double"))).alias("features"))
    score, quantity = F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("int")
    passes = F.array(F.lit("a"), F.when(quantity % 41 == 0, "a").otherwise("terminate"))
    cells = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("circuit"), F.format_string("%d:%d:%d", "l_linenumber", "l_partkey", "l_suppkey").alias("device"),
        (F.col("l_linenumber") * F.lit(10**15) + F.col("l_partkey") * F.lit(10**7) + F.col("l_suppkey")).alias("device_pos"), score.alias("score"),
        F.when(quantity % 43 == 0, score * 2).otherwise(score).alias("recomputed"), F.struct(F.lit("rl").alias("mode"), F.lit("success").alias("status"), F.lit("q").alias("qasm"), passes.alias("passes")).alias("compilation"),
        (F.col("l_returnflag") != "R").alias("fits"), (quantity % 47 != 0).alias("executable"))
    labels = C.best_device(cells.where("fits")).select("circuit", F.when(F.col("circuit").cast("long") % 23 == 0, "other").otherwise(F.col("label")).alias("label"))
    built = strict_export.build(circuits, cells, labels, ["num_qubits"])
    ok = F.col("reason").isNull()
    return built.select("idx", "reason", F.when(ok, F.col("record_id")).alias("record_id"), F.when(ok, F.col("label")).alias("label"), F.when(ok, F.round("margin", 6)).alias("margin"), F.when(ok, F.size("outcomes")).alias("n_outcomes"))


QUERIES = {f.__name__: f for f in (
    best_device_label, rank_margin, width_filter, build_jobs, width_reasons, compatibility_report, latest_by_key, attempts_status, mean_duration,
    finite_stats, seeded_cap, seeded_top, stratified_split, balanced_weights, record_ids, nearest_rows, nearest_rows_each, op_counts, unsupported_ops, json_field, coverage,
    pending, missing_by_device, device_queues, reason_examples, fidelity_product, label_counts, below_minimum, failure_counts, first_circuits,
    one_job_per_device, copy_plan, validate_plans, circuit_operations, circuit_problems, circuit_op_counts, circuit_features, circuit_gate_counts, circuit_summary,
    circuit_text, circuit_expansions, circuit_calls, circuit_refusals, parameter_values, success_probabilities, circuit_groups, group_split, paired_outcomes, paired_comparison, confusion, compiled_checks, compiled_fidelity, depth_scores, synthesis_limits, nearest_examples, trace_problems, strict_successes, log_lines, cell_states,
    instruction_summaries, device_records, provenance, all_failed, dense_scores, labelled_samples, strict_keys, changed_outputs, legacy_imports, last_errors, folds, balance_report,
    indexed_circuits, export_reasons)}

_LINES_SQL = """SELECT l_orderkey AS circuit, l_linenumber || ':' || l_partkey || ':' || l_suppkey AS device,
    CAST(l_linenumber AS BIGINT) * 1000000000000000 + l_partkey * 10000000 + l_suppkey AS device_pos, l_extendedprice AS score FROM lineitem"""
_DEV = f"(VALUES {_DEVICES_SQL}) AS d(device_id, dq, device_pos)"
_REQUEST_DEVICES = f"SELECT p_partkey AS request_id, p_size, device_id, dq, p_partkey % 3 = 0 AS listed FROM part CROSS JOIN {_DEV}"

#: The gates of the circuits that stand for orders, from the lines themselves: pos, op, wires.
_GATES = f"""SELECT l_orderkey AS name, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS pos,
    CASE l_returnflag WHEN 'R' THEN 'cx' WHEN 'A' THEN 'rz' ELSE 'measure' END AS op, l_linenumber AS line,
    CAST(l_partkey % {_WIRES} AS INTEGER) AS a, CAST((l_partkey % {_WIRES} + 1 + l_suppkey % {_WIRES - 1}) % {_WIRES} AS INTEGER) AS b FROM lineitem"""
#: With the longest paths: each step of the recursion applies the next gate of every circuit to the depths of its ten wires.
_PATHS = f"""WITH RECURSIVE g AS ({_GATES}),
    w AS (SELECT *, CASE op WHEN 'cx' THEN [a, b] WHEN 'rz' THEN [a] ELSE [a, a + {_WIRES}] END AS wires FROM g),
    p AS (SELECT DISTINCT name, 0 AS next, list_transform(range({2 * _WIRES}), lambda x: 0) AS levels FROM g
        UNION ALL SELECT p.name, p.next + 1, list_transform(range({2 * _WIRES}), lambda i: CASE WHEN list_contains(wires, i)
            THEN list_max(list_transform(wires, lambda k: levels[k + 1])) + 1000 + CASE WHEN op = 'cx' THEN 1 ELSE 0 END ELSE levels[i + 1] END)
        FROM p JOIN w ON p.name = w.name AND p.next = w.pos),
    path AS (SELECT name, max(list_max(levels)) AS m FROM p GROUP BY name),
    f AS (SELECT name, CAST(count(*) AS INTEGER) AS size, count(*) FILTER (op <> 'measure') AS gates, count(*) FILTER (op = 'cx') AS two,
        count(DISTINCT CASE WHEN op = 'cx' THEN least(a, b) * 10 + greatest(a, b) END) AS edges, sum(CASE WHEN op = 'cx' THEN 2 ELSE 1 END) AS active FROM g GROUP BY name),
    features AS (SELECT name, CAST(m // 1000 AS INTEGER) AS depth, size, round(2.0 * edges / {_WIRES * (_WIRES - 1)}, 9) AS program_communication,
        round(CASE WHEN two > 0 THEN (m % 1000) / CAST(two AS DOUBLE) ELSE 0 END, 9) AS critical_depth,
        round(CASE WHEN gates > 0 THEN two / CAST(gates AS DOUBLE) ELSE 0 END, 9) AS entanglement_ratio,
        round(greatest(0, (gates / CAST(m // 1000 AS DOUBLE) - 1) / {_WIRES - 1}), 9) AS parallelism, round(active / CAST({_WIRES} * (m // 1000) AS DOUBLE), 9) AS liveness
        FROM path JOIN f USING (name))"""
_OP_COUNTS = f"SELECT name, op, count(*) AS n FROM ({_GATES}) GROUP BY name, op"

#: The operations of the circuits over two registers: kind 0 to 5 by part, wires of the second register behind the first.
_EXPANDED = """WITH l AS (SELECT l_orderkey AS name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r, l_linenumber AS line,
        CAST(l_partkey % 3 AS INTEGER) AS i, CAST(3 + l_suppkey % 2 AS INTEGER) AS j, l_partkey % 6 AS kind FROM lineitem),
    e AS (SELECT name, r, 0 AS sub, 'rz' AS op, [i] AS q, CAST([] AS INTEGER[]) AS c, line / CAST(2 AS DOUBLE) AS v0, CAST(NULL AS DOUBLE) AS v1, CAST(NULL AS DOUBLE) AS v2 FROM l WHERE kind = 0
        UNION ALL SELECT name, r, 1, 'cx', [i, j], [], NULL, NULL, NULL FROM l WHERE kind = 0 UNION ALL SELECT name, r, 2, 'rz', [j], [], -pi(), NULL, NULL FROM l WHERE kind = 0
        UNION ALL SELECT name, r, 0, 'barrier', [0, 1, 2, j], [], NULL, NULL, NULL FROM l WHERE kind = 1
        UNION ALL SELECT name, r, k, 'h', [CAST(3 + k AS INTEGER)], [], NULL, NULL, NULL FROM l, range(2) AS t(k) WHERE kind = 2
        UNION ALL SELECT name, r, 0, 'cx', [i, j], [], NULL, NULL, NULL FROM l WHERE kind = 3
        UNION ALL SELECT name, r, k, 'measure', [CAST(k AS INTEGER)], [CAST(k AS INTEGER)], NULL, NULL, NULL FROM l, range(3) AS t(k) WHERE kind = 4
        UNION ALL SELECT name, r, 0, 'u3', [i], [], pi() / line, 0.5, -1 FROM l WHERE kind = 5),
    o AS (SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY r, sub) - 1 AS INTEGER) AS pos, op, q, c, v0, v1, v2 FROM e)"""

_OUTCOMES = """WITH l AS (SELECT l_orderkey AS circuit, l_linenumber || ':' || l_partkey || ':' || l_suppkey AS device,
        CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DOUBLE) END AS score, l_discount, l_tax FROM lineitem),
    c AS (SELECT DISTINCT circuit, first_value(device) OVER (PARTITION BY circuit ORDER BY l_discount DESC, device DESC) AS first,
        first_value(device) OVER (PARTITION BY circuit ORDER BY l_tax DESC, device DESC) AS second FROM l),
    m AS (SELECT circuit, max(CASE WHEN device = first THEN score END) AS a, max(CASE WHEN device = second THEN score END) AS b, max(score) AS best FROM l JOIN c USING (circuit) GROUP BY circuit),
    o AS (SELECT circuit, CASE WHEN a IS NULL AND b IS NULL THEN 'tie' WHEN b IS NULL THEN 'win' WHEN a IS NULL THEN 'loss' WHEN a > b THEN 'win' WHEN b > a THEN 'loss' ELSE 'tie' END AS outcome,
        best - a AS regret, a, b, best FROM m)"""

_CELL_STATES = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 40 THEN 'incompatible_num_qubits' WHEN l_linestatus <> 'F' THEN 'missing' WHEN l_linenumber = 1 THEN 'rl' ELSE 'unknown' END AS mode,
        CASE WHEN l_quantity > 40 THEN 'incompatible_num_qubits' WHEN l_linestatus <> 'F' THEN 'missing' WHEN l_returnflag = 'R' THEN 'success' ELSE 'unknown' END AS status FROM lineitem"""
_DEVICE_SCORES = """SELECT l_orderkey AS circuit, ([%s])[l_linenumber %% 3 + 1] AS device, max(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DOUBLE) END) AS score
        FROM lineitem WHERE l_linenumber < 3 GROUP BY ALL""" % ", ".join(f"'{name}'" for name, _ in DEVICES)

ORACLE_SQL = {
    "best_device_label": f"""SELECT circuit, device AS label, score AS best_score FROM ({_LINES_SQL})
        QUALIFY row_number() OVER (PARTITION BY circuit ORDER BY score DESC, device_pos, device) = 1""",
    "rank_margin": f"""SELECT circuit, device, score, second_score, score - second_score AS margin FROM (
        SELECT *, lead(score) OVER w AS second_score, row_number() OVER w AS r FROM ({_LINES_SQL})
        WINDOW w AS (PARTITION BY circuit ORDER BY score DESC, device)) WHERE r = 1""",
    "width_filter": f"SELECT p_partkey AS name, device_id, p_size AS num_qubits FROM part JOIN {_DEV} ON p_size <= dq",
    "build_jobs": f"""SELECT 'c' || p_partkey AS circuit, device_id AS device, CAST(device_pos AS INTEGER) AS device_pos, p_size AS num_qubits,
        'c' || p_partkey || '|' || device_id AS key, 'circuits/c' || p_partkey || '.qasm' AS source,
        'compiled/c' || p_partkey || '_expected_fidelity-' || device_id || '.qasm' AS output FROM part JOIN {_DEV} ON p_size <= dq""",
    "width_reasons": f"""SELECT request_id, device_id, concat_ws(',', CASE WHEN listed AND device_id <> 'ibm_falcon_27' THEN 'excluded_by_user' END,
        CASE WHEN p_size > dq THEN 'insufficient_qubits:' || p_size || '>' || dq END) AS reasons FROM ({_REQUEST_DEVICES})
        UNION ALL SELECT p_partkey, 'other_device', 'not_in_hardware_catalog' FROM part WHERE p_partkey % 3 = 0""",
    "compatibility_report": f"""SELECT request_id, coalesce(string_agg(device_id, ',' ORDER BY device_id) FILTER (p_size <= dq), '') AS available,
        coalesce(string_agg(device_id, ',' ORDER BY device_id) FILTER (p_size > dq), '') AS unavailable FROM ({_REQUEST_DEVICES}) GROUP BY request_id""",
    "latest_by_key": """SELECT user_id AS key, event_id AS line_no, event_type AS status, value AS duration_seconds FROM events WHERE event_type <> 'view'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
    "attempts_status": "SELECT user_id AS key, max(event_id % 4) AS attempts, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id",
    "mean_duration": "SELECT round(avg(value), 6) AS mean_seconds, count(*) AS n FROM events WHERE value IS NOT NULL",
    "finite_stats": """SELECT l_returnflag, count(x) AS count, min(x) AS min, round(avg(x), 9) AS mean, max(x) AS max FROM (
        SELECT l_returnflag, CASE WHEN l_linenumber <> 1 THEN l_discount END AS x FROM lineitem) GROUP BY l_returnflag""",
    "seeded_cap": """WITH c AS (SELECT greatest(1, floor(min(n) * 3.0)) AS cap FROM (SELECT count(*) AS n FROM labels GROUP BY quality))
        SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY sha256('7:' || doc_id), doc_id) AS r FROM labels), c WHERE r <= cap""",
    "seeded_top": "SELECT c_custkey, c_name FROM customer ORDER BY sha256('7:' || c_custkey), c_custkey LIMIT 50",
    "stratified_split": """SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('5:' || doc_id), doc_id)
        <= round(count(*) OVER (PARTITION BY quality) * CAST(0.7 AS DOUBLE)) AS is_train FROM labels""",
    "balanced_weights": """SELECT doc_id, quality, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*) OVER (PARTITION BY quality)), 9) AS weight FROM labels""",
    "record_ids": "SELECT doc_id, substr(sha256('expected_fidelity:' || doc_id || ':' || sha256(text)), 1, 24) AS record_id FROM documents",
    "nearest_rows": """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0)
        SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: abs(CAST(embedding[i] AS DOUBLE) - CAST(v[i] AS DOUBLE))
        / (1 + greatest(abs(CAST(embedding[i] AS DOUBLE)), abs(CAST(v[i] AS DOUBLE)))))) / len(embedding), 6) AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 5""",
    "nearest_rows_each": """WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i:
        abs(CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)) / (1 + greatest(abs(CAST(e.embedding[i] AS DOUBLE)), abs(CAST(q.embedding[i] AS DOUBLE)))))) / len(e.embedding) AS d
        FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INTEGER) AS rank, vec_id, round(d, 6) AS distance FROM p
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) <= 5""",
    "op_counts": "SELECT doc_id, op, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([a-z]+)')) AS op FROM documents) GROUP BY doc_id, op",
    "unsupported_ops": """SELECT l_orderkey, array_to_string(list_sort(list_filter(list(DISTINCT l_returnflag || l_linestatus), lambda x: x NOT IN ('AF', 'NO'))), ',') AS unsupported
        FROM lineitem GROUP BY l_orderkey""",
    "json_field": """SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE -1 END AS k,
        json_type(props) = 'OBJECT' AS is_object FROM events""",
    "coverage": """SELECT o_custkey AS circuit, count(*) AS n_jobs, count(l_orderkey) AS n_valid, count(*) = count(l_orderkey) AS complete
        FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey GROUP BY o_custkey""",
    "pending": """SELECT o_orderkey AS key, o_custkey, attempts FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS attempts FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
        WHERE coalesce(attempts, 0) < 4 AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = o_orderkey AND x.l_returnflag = 'R')""",
    "missing_by_device": """SELECT o_orderpriority AS device, count(*) AS n_jobs, count(*) - count(l_orderkey) AS n_missing FROM orders
        LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey GROUP BY o_orderpriority""",
    "device_queues": """SELECT o_orderpriority AS device, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey % 5, o_orderkey) AS INTEGER) AS position, o_orderkey AS key FROM orders""",
    "reason_examples": """SELECT o_orderpriority AS reason, count(*) AS n, array_to_string(list_slice(list(o_orderkey ORDER BY o_orderkey), 1, 5), ',') AS examples
        FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_orderpriority""",
    "fidelity_product": "SELECT l_orderkey, list_reduce(list_prepend(CAST(1 AS DOUBLE), list_sort(list(1 - l_discount))), lambda a, b: a * b) AS fidelity FROM lineitem GROUP BY l_orderkey",
    "label_counts": "SELECT lang AS label, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang",
    "below_minimum": """SELECT device, count(lang) AS n FROM (VALUES ('en'), ('de'), ('es'), ('it')) AS t(device) LEFT JOIN documents ON lang = device GROUP BY device HAVING count(lang) < 120""",
    "failure_counts": """SELECT CAST(sum(bad) AS BIGINT) AS failed_cells, count(*) FILTER (bad = n) AS failed_circuits FROM (
        SELECT count(*) FILTER (l_returnflag = 'R') AS bad, count(*) AS n FROM lineitem GROUP BY l_orderkey)""",
    "first_circuits": """SELECT l_quantity AS num_qubits, l_orderkey AS circuit, l_suppkey AS device FROM lineitem WHERE (l_quantity, l_orderkey) IN (
        SELECT (l_quantity, l_orderkey) FROM (SELECT DISTINCT l_quantity, l_orderkey FROM lineitem ORDER BY 1, 2 LIMIT 40))""",
    "one_job_per_device": """SELECT o_orderpriority AS device, o_custkey % 5 AS num_qubits, o_orderkey AS circuit FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey % 5, o_orderkey) = 1""",
    "copy_plan": """WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS name, sha256(text) AS h, doc_id FROM documents),
        t AS (SELECT CASE WHEN doc_id % 3 = 0 THEN name || '-moved' ELSE name END AS name, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE h END AS h FROM s)
        SELECT coalesce(s.name, t.name) AS name, CASE WHEN s.h IS NULL THEN 'extra' WHEN t.h IS NULL THEN 'copy' WHEN s.h = t.h THEN 'skip' ELSE 'conflict' END AS action
        FROM s FULL OUTER JOIN t ON s.name = t.name""",
    "validate_plans": f"""WITH l AS (SELECT *, l_partkey % 17 AS k, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
        r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN k = 0 THEN ['response must be a JSON object'] ELSE list_filter([
            CASE WHEN l_returnflag = 'R' THEN 'selected_device is not an available device' END,
            CASE WHEN k = 1 THEN 'figure_of_merit differs from the request' END,
            CASE WHEN k = 2 THEN 'compiler must be qiskit' END,
            CASE WHEN k = 3 THEN 'qiskit_plan must be an object' END,
            CASE WHEN k = 3 OR q % 6 > 3 THEN 'optimization_level must be an integer from 0 to 3' END,
            CASE WHEN k = 3 OR k = 4 THEN 'seed_transpiler must be an unsigned 32-bit integer' END,
            CASE WHEN k <> 3 AND q % 7 = 0 THEN 'layout_method is not permitted' END,
            CASE WHEN k = 5 THEN 'routing_method is not permitted' END,
            CASE WHEN k <> 3 AND q % 6 > 2 THEN 'optimization_level exceeds the constraint' END,
            CASE WHEN k = 7 OR k = 8 THEN 'explanation must be a non-blank string' END,
            CASE WHEN k = 9 OR l_linestatus <> 'F' THEN 'evidence must be a list of non-blank strings' END,
            CASE WHEN k = 10 THEN 'warnings must be a list of non-blank strings' END], lambda x: x IS NOT NULL) END AS e FROM l)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(len(e) AS INTEGER) AS n_errors, array_to_string(e, '; ') AS errors, len(e) = 0 AS is_valid FROM r""",
    "circuit_operations": f"""SELECT name, pos, op, CASE WHEN op = 'rz' THEN 'pi/(' || line || '+(1))' ELSE '' END AS params,
        CASE WHEN op = 'cx' THEN a || ',' || b ELSE '' || a END AS qubits, CASE WHEN op = 'measure' THEN '' || a ELSE '' END AS clbits FROM ({_GATES})""",
    "circuit_problems": """SELECT DISTINCT l_orderkey AS name, CASE l_orderkey % 5 WHEN 0 THEN 'no_header' WHEN 1 THEN 'unknown_argument' WHEN 2 THEN 'blank' WHEN 3 THEN 'no_qubits' END AS problem FROM lineitem""",
    "circuit_op_counts": _OP_COUNTS,
    "circuit_features": f"{_PATHS} SELECT * FROM features",
    "circuit_gate_counts": f"""SELECT name, count(*) FILTER (op = 'cx') AS gate_count_cx, count(*) FILTER (op = 'rz') AS gate_count_rz, CAST(0 AS BIGINT) AS gate_count_h FROM ({_GATES}) GROUP BY name""",
    "circuit_summary": f"""{_PATHS} SELECT name, {_WIRES} AS num_qubits, {_WIRES} AS num_clbits, depth, size, op_counts FROM features
        JOIN (SELECT name, string_agg(op || ':' || n, ',' ORDER BY op) AS op_counts FROM ({_OP_COUNTS}) GROUP BY name) USING (name)""",
    "circuit_text": f"""SELECT name, 'OPENQASM 2.0;' || chr(10) || 'include "qelib1.inc";' || chr(10) || 'qreg q[{_WIRES}];' || chr(10) || 'creg c[{_WIRES}];' || chr(10) ||
        string_agg(CASE op WHEN 'cx' THEN 'cx q[' || a || '],q[' || b || '];' WHEN 'rz' THEN 'rz(pi/(' || line || '+(1))) q[' || a || '];'
        ELSE 'measure q[' || a || '] -> c[' || a || '];' END, chr(10) ORDER BY pos) || chr(10) AS text FROM ({_GATES}) GROUP BY name""",
    "circuit_expansions": f"""{_EXPANDED} SELECT name, pos, op, array_to_string(q, ',') AS qubits, array_to_string(c, ',') AS clbits,
        round(v0, 9) AS value_0, round(v1, 9) AS value_1, round(v2, 9) AS value_2, CAST(NULL AS VARCHAR) AS problem FROM o""",
    "circuit_calls": """SELECT name, op, CAST(sum(n) AS BIGINT) AS n FROM (SELECT l_orderkey AS name, CASE l_partkey % 6 WHEN 0 THEN 'kick' WHEN 1 THEN 'barrier' WHEN 2 THEN 'h' WHEN 3 THEN 'cx' WHEN 4 THEN 'measure' ELSE 'u3' END AS op,
        CASE l_partkey % 6 WHEN 2 THEN 2 WHEN 4 THEN 3 ELSE 1 END AS n FROM lineitem) GROUP BY name, op""",
    "circuit_refusals": f"""SELECT DISTINCT l_orderkey AS name, CASE l_orderkey % {len(_DEFECTS)} {" ".join(f"WHEN {k} THEN '{what}'" for k, (_, what) in enumerate(_DEFECTS) if what)} END AS problem FROM lineitem""",
    "parameter_values": """WITH n AS (SELECT *, CAST(l_linenumber AS DOUBLE) AS line, CAST(l_quantity AS DOUBLE) AS q, CAST(l_suppkey % 7 AS DOUBLE) AS s FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE CAST(q AS INTEGER) % 4 WHEN 0 THEN -pi() / (line + s) * pow(2, -s)
            WHEN 1 THEN pow(sin(q), 2) + pow(cos(q), 2) - line * CAST(0.1 AS DOUBLE) / -4 WHEN 2 THEN sqrt(q) - ln(line) * (1 - (2 - (3 - s))) END, 9) AS value, true AS valid FROM n""",
    "success_probabilities": f"""{_EXPANDED.replace("WITH l", "WITH RECURSIVE l", 1)},
        g AS (SELECT name, pos, op, q, CASE op WHEN 'h' THEN 30 WHEN 'u3' THEN 50 WHEN 'cx' THEN 200 + 10 * q[2] WHEN 'measure' THEN 700 + q[1] ELSE 0 END AS duration,
            1 - CASE op WHEN 'h' THEN CAST(0.001 AS DOUBLE) * (1 + q[1]) WHEN 'u3' THEN CAST(0.002 AS DOUBLE) * (1 + q[1]) WHEN 'cx' THEN CAST(0.01 AS DOUBLE) * (1 + q[1])
                WHEN 'measure' THEN CAST(0.004 AS DOUBLE) * (1 + q[1]) ELSE 0 END AS factor FROM o),
        p AS (SELECT DISTINCT name, 0 AS next, [0, 0, 0, 0, 0] AS free, [-1, -1, -1, -1, -1] AS ended, [0, 0, 0, 0, 0] AS idle FROM g
            UNION ALL SELECT name, next, list_transform(range(5), lambda w: CASE WHEN list_contains(q, w) THEN b + duration ELSE free[w + 1] END),
                list_transform(range(5), lambda w: CASE WHEN list_contains(q, w) AND op <> 'barrier' THEN b + duration ELSE ended[w + 1] END),
                list_transform(range(5), lambda w: idle[w + 1] + CASE WHEN list_contains(q, w) AND op <> 'barrier' AND ended[w + 1] >= 0 THEN b - ended[w + 1] ELSE 0 END)
            FROM (SELECT p.name, p.next + 1 AS next, free, ended, idle, q, op, duration, list_max(list_transform(q, lambda w: free[w + 1])) AS b FROM p JOIN g ON p.name = g.name AND p.next = g.pos)),
        last AS (SELECT name, greatest(list_max(ended), 0) AS length, idle FROM p QUALIFY row_number() OVER (PARTITION BY name ORDER BY next DESC) = 1),
        f AS (SELECT name, list_reduce(list_prepend(CAST(1 AS DOUBLE), list_sort(list(factor) FILTER (op <> 'barrier'))), lambda x, y: x * y) AS product FROM g GROUP BY name)
        SELECT name, CAST(length AS DOUBLE) AS length, CAST(list_sum(idle) AS DOUBLE) AS idle, round(coalesce(product, 1)
            * exp(-list_sum(list_transform(range(5), lambda w: idle[w + 1] / CAST(least(50000 + 1000 * w, 47000 + 2000 * w) AS DOUBLE)))), 9) AS score FROM last JOIN f USING (name)""",
    "circuit_groups": f"""SELECT name, sha256(string_agg(op || ' ' || CASE op WHEN 'cx' THEN a || ',' || b ELSE '' || a END || ' ' || CASE op WHEN 'measure' THEN '' || a ELSE '' END, ';' ORDER BY pos)) AS sequence
        FROM ({_GATES}) GROUP BY name""",
    "group_split": """WITH p AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL),
        g AS (SELECT o_custkey, sum(n) OVER (PARTITION BY o_custkey) AS n, o_orderpriority AS class, sha256('5:' || o_custkey) AS k FROM p
            QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY p.n DESC, o_orderpriority) = 1),
        m AS (SELECT o_custkey, (coalesce(sum(n) OVER (PARTITION BY class ORDER BY k, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) / sum(n) OVER (PARTITION BY class) AS middle FROM g)
        SELECT o_orderkey, o_custkey, CASE WHEN middle < 0.7 THEN 'train' WHEN middle < 0.8 THEN 'validation' ELSE 'test' END AS side FROM orders JOIN m USING (o_custkey)""",
    "paired_outcomes": f"""{_OUTCOMES} SELECT circuit, outcome, round(regret, 6) AS regret, round(a, 6) AS first_score, round(b, 6) AS second_score, round(best, 6) AS best_score FROM o""",
    "paired_comparison": f"""{_OUTCOMES} SELECT count(*) AS n, count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'tie') AS ties, count(*) FILTER (outcome = 'loss') AS losses,
        count(*) FILTER (a IS NULL) AS failures, round(avg(regret), 4) AS mean_regret, round(max(regret), 4) AS max_regret FROM o""",
    "confusion": """SELECT o_orderstatus AS label, o_orderpriority AS predicted, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS DOUBLE), 9) AS share
        FROM orders GROUP BY o_orderstatus, o_orderpriority""",
    "compiled_checks": f"""WITH c AS (SELECT name, device, bool_or(op = 'rz') AS rz, string_agg(DISTINCT op, ',' ORDER BY op) AS used,
            bool_and(op <> 'cx' OR device = 'full' OR (device = 'ring' AND ((a + 1) % {_WIRES} = b OR (b + 1) % {_WIRES} = a))) AS fits_coupling
        FROM ({_GATES}), (VALUES ('ring'), ('full'), ('unknown')) AS d(device) GROUP BY name, device),
        u AS (SELECT name, device, CASE WHEN device = 'unknown' THEN used WHEN device = 'full' AND rz THEN 'rz' ELSE '' END AS unsupported, fits_coupling FROM c)
        SELECT name, device, unsupported, unsupported = '' AS native_basis, fits_coupling, unsupported = '' AND fits_coupling AS executable FROM u""",
    "compiled_fidelity": f"""SELECT name, 'full' AS device, CASE WHEN bool_or(op = 'cx' AND a = 4) THEN NULL
        ELSE round(list_reduce(list_prepend(CAST(1 AS DOUBLE), list_sort(list(1 - CASE WHEN op = 'cx' THEN CAST(0.01 AS DOUBLE) ELSE CAST(0.001 AS DOUBLE) END * (1 + a)))), lambda x, y: x * y), 12) END AS score
        FROM ({_GATES}) GROUP BY name""",
    "depth_scores": f"{_PATHS} SELECT name, round(1 - critical_depth, 9) AS score FROM features",
    "synthesis_limits": """SELECT l_suppkey AS device_id, CAST(max(CASE WHEN l_returnflag <> 'N' AND l_quantity = 3 THEN 3 ELSE 2 END) AS INTEGER) AS "limit" FROM lineitem GROUP BY l_suppkey""",
    "nearest_examples": """WITH d AS (SELECT s_suppkey AS request_id, p_partkey AS record_id, p_partkey % 3 = 0 AS ab,
            (abs(s_suppkey % 50 - p_size) / (1 + greatest(s_suppkey % 50, p_size)) + abs(1000 + s_suppkey - CAST(p_retailprice AS DOUBLE)) / (1 + greatest(CAST(1000 + s_suppkey AS DOUBLE), CAST(p_retailprice AS DOUBLE)))) / 2 AS d
        FROM supplier JOIN part ON s_suppkey % 2 = p_partkey % 2 AND (s_suppkey % 3 = 0) = (p_partkey % 3 = 0) WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0)
        SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY d, record_id) AS INTEGER) AS rank, record_id, round(d, 9) AS distance, CAST(record_id AS VARCHAR) AS shown_name,
        CAST(CASE WHEN ab THEN 2 ELSE 1 END AS INTEGER) AS shown_backends FROM d QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY d, record_id) <= 3""",
    "trace_problems": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linestatus <> 'F' THEN 'missing_compilation' ELSE CASE CAST(l_quantity AS INTEGER) % 7 WHEN 1 THEN 'mode_fallback'
        WHEN 2 THEN 'status_timeout' WHEN 3 THEN 'empty_pass_trace' WHEN 4 THEN 'fallback_pass_in_trace' WHEN 5 THEN 'trace_without_terminal_action' WHEN 6 THEN 'mode_none' END END AS problem FROM lineitem""",
    "strict_successes": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id % 3 = 0 OR event_id % 7 = 0 WHEN 1 THEN false
        ELSE (event_id % 3 <> 1) AND event_id % 4 <> 0 END AS strict FROM events""",
    "log_lines": """SELECT event_id AS line_no, CASE event_id % 4 WHEN 0 THEN CASE WHEN json_type(props, '$.key') = 'VARCHAR' THEN 'kept' ELSE 'key_not_a_string' END
        WHEN 1 THEN 'not_json' WHEN 2 THEN 'not_an_object' ELSE 'kept' END AS reason FROM events""",
    "cell_states": _CELL_STATES,
    "instruction_summaries": """SELECT l_suppkey AS device_id, l_returnflag AS name, count(e) AS errors_count, min(e) AS errors_min, round(avg(e), 9) AS errors_mean, max(e) AS errors_max,
        count(d) AS durations_count, min(d) AS durations_min, round(avg(d), 9) AS durations_mean, max(d) AS durations_max FROM (SELECT l_suppkey, l_returnflag,
        CASE WHEN l_linenumber <> 1 THEN CAST(l_discount AS DOUBLE) END AS e, CASE WHEN l_linestatus = 'F' THEN CAST(l_tax AS DOUBLE) END AS d FROM lineitem) GROUP BY ALL""",
    "device_records": """WITH l AS (SELECT *, l_partkey % 5 AS a, (l_partkey + 1 + l_linenumber % 4) % 5 AS b FROM lineitem),
        e AS (SELECT l_suppkey, string_agg(a || '>' || b, ',' ORDER BY a, b) AS edges FROM (SELECT DISTINCT l_suppkey, a, b FROM l WHERE l_returnflag = 'R') GROUP BY l_suppkey),
        i AS (SELECT l_suppkey, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (l_linenumber = 2) AS INTEGER) AS u, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS ops FROM l GROUP BY l_suppkey)
        SELECT s_suppkey AS device_id, 'A,R' AS operation_names, edges, n AS n_instructions, u AS n_unknown, ops AS summarised
        FROM supplier LEFT JOIN e ON s_suppkey = e.l_suppkey LEFT JOIN i ON s_suppkey = i.l_suppkey""",
    "provenance": f"SELECT mode, count(*) AS n FROM ({_CELL_STATES}) GROUP BY mode",
    "all_failed": """SELECT count(*) AS n_circuits, count(*) FILTER (NOT ok) AS n_dropped FROM (SELECT bool_or(l_returnflag <> 'R' AND l_linestatus <> 'F') AS ok FROM lineitem GROUP BY l_orderkey)""",
    "dense_scores": f"""SELECT o_orderkey AS circuit, d.device_id AS device, CAST(d.device_pos AS INTEGER) AS device_pos, coalesce(score, -1) AS score
        FROM orders CROSS JOIN {_DEV} LEFT JOIN ({_DEVICE_SCORES}) s ON s.circuit = o_orderkey AND s.device = d.device_id""",
    "labelled_samples": f"""SELECT circuit, any_value(label) AS label, CAST(any_value(o_custkey) % 5 AS DOUBLE) AS num_qubits, string_agg(device, ',' ORDER BY device) AS scored
        FROM (SELECT s.circuit, s.device, first_value(s.device) OVER (PARTITION BY s.circuit ORDER BY score DESC NULLS LAST, d.device_pos) AS label, max(score) OVER (PARTITION BY s.circuit) AS best
            FROM ({_DEVICE_SCORES}) s JOIN {_DEV} ON s.device = d.device_id) JOIN orders ON o_orderkey = circuit WHERE best IS NOT NULL GROUP BY circuit""",
    "strict_keys": """SELECT user_id AS key FROM (SELECT user_id, event_id, event_type FROM events WHERE event_type <> 'view'
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
        WHERE event_type = 'click' AND (event_id % 3 <> 1 OR event_id % 6 = 1) AND event_id % 4 <> 0 AND user_id IN (SELECT o_custkey FROM orders)""",
    "changed_outputs": "SELECT o_orderkey AS key FROM orders WHERE o_orderstatus <> 'P' AND (o_orderkey % 7 = 0 OR (o_orderkey % 5 = 0 AND o_custkey <> 0))",
    "legacy_imports": """SELECT o_orderkey AS key, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
        AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')""",
    "last_errors": """WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity > 45 AS ok, l_returnflag || ',' || l_partkey AS errors FROM lineitem
            QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1)
        SELECT l_orderkey AS request_id, max(l_linenumber) AS attempts, arg_max(errors, l_linenumber) AS errors FROM a GROUP BY l_orderkey HAVING NOT bool_or(ok)""",
    "folds": """SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY sha256('5:' || doc_id), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels""",
    "balance_report": """WITH n AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)
        SELECT lang AS label, n AS before, least(n, CAST(greatest(1, floor((SELECT min(n) FROM n) * 1.5)) AS BIGINT)) AS after FROM n""",
    "indexed_circuits": "SELECT 'c' || o_orderkey AS circuit, o_custkey, row_number() OVER (ORDER BY 'c' || o_orderkey) - 1 AS index FROM orders",
    "export_reasons": """WITH l AS (SELECT l_orderkey AS k, l_linenumber || ':' || l_partkey || ':' || l_suppkey AS device, CAST(l_linenumber AS BIGINT) * 1000000000000000 + l_partkey * 10000000 + l_suppkey AS pos,
            CAST(l_extendedprice AS DOUBLE) AS score, CAST(l_quantity AS INTEGER) AS q FROM lineitem WHERE l_returnflag <> 'R'),
        p AS (SELECT *, CASE WHEN q % 41 = 0 THEN 'trace_without_terminal_action' WHEN q % 43 = 0 THEN 'score_mismatch' WHEN q % 47 = 0 THEN 'not_executable' END AS problem FROM l),
        c AS (SELECT k, arg_min(problem, pos) FILTER (problem IS NOT NULL) AS problem, count(*) AS n, list(device ORDER BY score DESC, device)[1] AS best,
            list(score ORDER BY score DESC)[1] - list(score ORDER BY score DESC)[2] AS margin FROM p GROUP BY k),
        r AS (SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 11 = 0 THEN 'source_missing' WHEN o_orderkey % 13 = 0 THEN 'feature_set_mismatch' WHEN o_orderkey % 17 = 0 THEN 'feature_not_finite'
            WHEN o_orderkey % 19 = 0 AND o_custkey % 50 <> 77 THEN 'width_mismatch' WHEN k IS NULL THEN 'no_compatible_device' WHEN problem IS NOT NULL THEN problem
            WHEN o_orderkey % 23 = 0 THEN 'label_argmax_mismatch' END AS reason, best, margin, n FROM orders LEFT JOIN c ON k = o_orderkey)
        SELECT idx, reason, CASE WHEN reason IS NULL THEN substr(sha256('expected_fidelity:' || idx || ':' || sha256('text of ' || idx)), 1, 24) END AS record_id,
            CASE WHEN reason IS NULL THEN best END AS label, CASE WHEN reason IS NULL THEN round(margin, 6) END AS margin, CASE WHEN reason IS NULL THEN CAST(n AS INTEGER) END AS n_outcomes FROM r""",
}
