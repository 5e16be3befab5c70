"""OpenQASM 2 text as ordered operations, by column functions only, and folds over the operations.

The grammar is that of the OpenQASM 2 paper: statements end with a semicolon or with the body of a definition; ``//`` starts a
comment; registers and gates are declared before use; ``if (c==n)`` guards are checked and dropped from a statement. The gates of the
public library count as declared. A statement over whole registers of one size stands for one operation for each index, except
``barrier``, which is one operation over all wires. Calls of gates that the text defines are operations of that
name; :func:`expand_definitions` puts their bodies in their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schemas
from . import expressions as E
from .expressions import bind

#: Names that are no gate: they count neither as gate nor as layer.
NOT_GATES = ("barrier", "measure", "reset")
#: The gates of the public OpenQASM 2 library that the feature vector counts, and the features behind them.
GATES = ("u3", "u2", "u1", "cx", "id", "u0", "u", "p", "x", "y", "z", "h", "s", "sdg", "t", "tdg", "rx", "ry", "rz", "sx", "sxdg",
         "cz", "cy", "swap", "ch", "ccx", "cswap", "crx", "cry", "crz", "cu1", "cp", "cu3", "csx", "cu", "rxx", "rzz", "rccx", "rc3x", "c3x", "c3sqrtx", "c4x")
SHAPE_FEATURES = ("num_qubits", "depth", "program_communication", "critical_depth", "entanglement_ratio", "parallelism", "liveness")
FEATURE_NAMES = (*(f"gate_count_{g}" for g in GATES), *SHAPE_FEATURES)
#: Parameters and qubits of the library's gates and of the two that the language has without it.
SIGNATURES = {
    "U": (3, 1), "CX": (0, 2), "u3": (3, 1), "u2": (2, 1), "u1": (1, 1), "cx": (0, 2), "id": (0, 1), "u0": (1, 1), "u": (3, 1), "p": (1, 1),
    "x": (0, 1), "y": (0, 1), "z": (0, 1), "h": (0, 1), "s": (0, 1), "sdg": (0, 1), "t": (0, 1), "tdg": (0, 1), "rx": (1, 1), "ry": (1, 1), "rz": (1, 1),
    "sx": (0, 1), "sxdg": (0, 1), "cz": (0, 2), "cy": (0, 2), "swap": (0, 2), "ch": (0, 2), "ccx": (0, 3), "cswap": (0, 3), "crx": (1, 2), "cry": (1, 2),
    "crz": (1, 2), "cu1": (1, 2), "cp": (1, 2), "cu3": (3, 2), "csx": (0, 2), "cu": (4, 2), "rxx": (1, 2), "rzz": (1, 2), "rccx": (0, 3), "rc3x": (0, 4),
    "c3x": (0, 4), "c3sqrtx": (0, 4), "c4x": (0, 5)}
#: A call: name, parameters up to the last parenthesis, arguments, which hold none.
_CALL = r"(?s)^([A-Za-z_]\w*) ?(?:\((.*)\))? ?([^()]*)$"
_ARGUMENT = r"^([A-Za-z_]\w*) ?(?:\[ ?(\d+) ?\])?$"
_REGISTER = r"^(qreg|creg) ([A-Za-z_]\w*) ?\[ ?(\d+) ?\]$"
_DEFINITION = r"(?s)^(gate|opaque) ([A-Za-z_]\w*) ?(?:\(([^()]*)\))? ?([^(){};]*?) ?(?:\{(.*)\})?$"
_GUARD = r"^if ?\( ?([A-Za-z_]\w*) ?== ?\d+ ?\) ?"
_NAME = r"^[A-Za-z_]\w*$"
_REGISTERS = "array<struct<name:string,size:int,first:int,kind:string,at:int>>"
_DEFINITIONS = "array<struct<name:string,params:array<string>,wires:array<string>,body:array<struct<op:string,params:array<string>,args:array<string>>>,opaque:boolean,valid:boolean,at:int>>"
_FLAT = "array<struct<name:string,params:array<string>,body:array<struct<op:string,params:array<string>,wires:array<int>>>>>"
#: So many distinct statements are sent to every task, if what each stands for has at most so many characters.
MAX_SENT, MAX_MEANING = 2048, 1 << 12


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"//[^\n]*", "")


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _pieces(text: Column) -> Column:
    """The text of every statement but header and includes, without comments; definitions are one statement each."""
    pieces = F.regexp_extract_all(F.when(text.contains("//"), _plain(text)).otherwise(text), F.lit(r"[^;{}]*+(?:\{[^{}]*+\}|;)|[^;{}]++|[{}]"), F.lit(0))
    return F.filter(pieces, lambda p: ~p.rlike(r"(?s)^\s*+(?:;|(?:OPENQASM|include)\b.*;)?\z"))


def _statements(pieces: Column) -> Column:
    """(text, guard, at) of every piece that is a statement.

    A piece that neither a semicolon nor a body ends keeps a mark that no grammar allows.
    """
    def one(piece: Column, i: Column) -> Column:
        tidy = F.when(piece.endswith(";"), _tidy(F.substring(piece, F.lit(1), F.length(piece) - 1))).when(
            piece.endswith("}"), _tidy(piece)).when(_tidy(piece) == "", F.lit("")).otherwise(F.concat(F.lit("\\"), piece))
        return bind(tidy, lambda s: F.struct(F.regexp_replace(s, _GUARD, "").alias("text"), F.regexp_extract(s, _GUARD, 1).alias("guard"), i.cast("int").alias("at")))

    return F.filter(F.transform(pieces, one), lambda s: (s["text"] != "") & ~s["text"].rlike(r"^(OPENQASM|include)\b"))


def _registers(statements: Column) -> Column:
    """Registers in order; ``first`` counts the wires of their kind before. A size beyond an int is none."""
    declared = F.transform(F.filter(statements, lambda s: s["text"].rlike(_REGISTER)), lambda s: F.struct(
        F.regexp_extract(s["text"], _REGISTER, 2).alias("name"), F.coalesce(F.regexp_extract(s["text"], _REGISTER, 3).try_cast("int"), F.lit(0)).alias("size"),
        F.regexp_extract(s["text"], _REGISTER, 1).alias("kind"), s["at"].alias("at")))
    return F.aggregate(declared, F.array().cast(_REGISTERS), lambda acc, r: F.concat(acc, F.array(F.struct(
        r["name"].alias("name"), r["size"].alias("size"), F.aggregate(acc, F.lit(0), lambda t, x: t + F.when(x["kind"] == r["kind"], x["size"]).otherwise(0)).alias("first"),
        r["kind"].alias("kind"), r["at"].alias("at")))))


def _total(registers: Column, kind: str) -> Column:
    return F.aggregate(registers, F.lit(0), lambda t, r: t + F.when(r["kind"] == kind, r["size"]).otherwise(0))


def _call(text: Column) -> Column:
    """(op, params, args) of a statement; no name if it has not the form of a call."""
    args = F.regexp_extract(text, _CALL, 3)
    return F.struct(F.regexp_extract(text, _CALL, 1).alias("op"), E.parts(F.regexp_extract(text, _CALL, 2)).alias("params"),
                    F.when(F.trim(args) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(args, ","), lambda a: F.trim(a))).alias("args"))


def _signature(op: Column, definitions: Column, at: Column) -> Column:
    """(params, wires) of a gate that is known where it is called: an earlier definition of the text, else the library's."""
    own = F.get(F.filter(definitions, lambda d: (d["name"] == op) & (d["at"] < at)), 0)
    table = F.expr("map(" + ", ".join(f"'{name}', named_struct('params', {p}, 'wires', {w})" for name, (p, w) in SIGNATURES.items()) + ")")
    library = F.try_element_at(table, op)
    return F.when(own.isNotNull(), F.struct(F.size(own["params"]).alias("params"), F.size(own["wires"]).alias("wires"))).otherwise(library)


def _definitions(statements: Column) -> Column:
    """Definitions in order, as they stand."""
    names = lambda s: F.when(F.trim(s) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(s, ","), lambda n: F.trim(n)))

    def one(s: Column) -> Column:
        at = lambda k: F.regexp_extract(s["text"], _DEFINITION, k)
        calls = F.transform(F.filter(F.split(at(5), ";"), lambda c: F.trim(c) != ""), lambda c: _call(F.trim(c)))
        return F.struct(at(2).alias("name"), names(at(3)).alias("params"), names(at(4)).alias("wires"), calls.alias("body"), (at(1) == "opaque").alias("opaque"), s["at"].alias("at"))

    return F.transform(F.filter(statements, lambda s: s["text"].rlike(r"^(gate|opaque)\b")), one)


def _checked(definitions: Column, bad_params: Column) -> Column:
    """The definitions, each with ``valid``: its names are names, none comes twice, and its body calls gates that are
    known before it, with their numbers of parameters and wires, over its own wires and parameters only."""
    distinct = lambda a: F.size(F.array_distinct(a)) == F.size(a)

    def checked(acc: Column, d: Column) -> Column:
        def fine(c: Column) -> Column:
            over_own = (F.size(F.array_except(c["args"], d["wires"])) == 0) & distinct(c["args"]) & (F.size(c["args"]) > 0)
            values = ~F.arrays_overlap(c["params"], bad_params) & (F.size(F.array_except(F.flatten(F.transform(c["params"], E.free_names)), d["params"])) == 0)
            known = bind(_signature(c["op"], acc, d["at"]), lambda g: (g["params"] == F.size(c["params"])) & (g["wires"] == F.size(c["args"])))
            return over_own & F.when(c["op"] == "barrier", F.size(c["params"]) == 0).otherwise(F.coalesce(known & values, F.lit(False)))

        named = (d["name"] != "") & F.forall(F.concat(d["params"], d["wires"]), lambda n: n.rlike(_NAME)) & distinct(F.concat(d["params"], d["wires"])) & (F.size(d["wires"]) > 0)
        new = ~F.exists(acc, lambda x: x["name"] == d["name"])
        valid = named & new & F.when(d["opaque"], F.size(d["body"]) == 0).otherwise(F.forall(d["body"], fine))
        return F.concat(acc, F.array(F.struct(d["name"].alias("name"), d["params"].alias("params"), d["wires"].alias("wires"), d["body"].alias("body"),
                                              d["opaque"].alias("opaque"), valid.alias("valid"), d["at"].alias("at"))).cast(_DEFINITIONS))

    return F.aggregate(definitions, F.expr(f"cast(array() as {_DEFINITIONS})"), checked)


def _argument(argument: Column, registers: Column, at: Column) -> Column:
    """(kind, wires, whole): one wire for ``r[i]``, all of the register for ``r``; no kind and no wire if it is none that is declared before."""
    name, index = F.regexp_extract(argument, _ARGUMENT, 1), F.regexp_extract(argument, _ARGUMENT, 2)
    none = F.struct(F.lit(None).cast("string").alias("kind"), F.array().cast("array<int>").alias("wires"), F.lit(False).alias("whole"))

    def of(r: Column) -> Column:
        number = index.try_cast("int")
        wires = F.when((index == "") & (r["size"] > 0), F.sequence(r["first"], r["first"] + r["size"] - 1)).when(
            number < r["size"], F.array(r["first"] + number)).otherwise(F.array().cast("array<int>"))
        return F.struct(r["kind"].alias("kind"), wires.alias("wires"), (index == "").alias("whole"))

    found = F.get(F.filter(registers, lambda r: (r["name"] == name) & (r["at"] < at)), 0)
    return F.when(found.isNull(), none).otherwise(bind(found, of))


# Columns that a lambda uses are bound first: Catalyst may put a column's expression in its place, and there it would run for every item.


def _with_call(s: Column) -> Column:
    """A statement with its call: (text, guard, at, arrow, call). Measurement has its own arrow; as a comma it is a call of two arguments."""
    head = F.regexp_extract(s["text"], r"^measure (.*)$", 1)
    arrow = head.rlike("^[^,>]*->[^,>]*$")
    call = _call(F.when(arrow, F.concat(F.lit("measure "), F.replace(head, F.lit("->"), F.lit(",")))).otherwise(s["text"]))
    return F.struct(s["text"].alias("text"), s["guard"].alias("guard"), s["at"].alias("at"), arrow.alias("arrow"), call.alias("call"))


def _rows(s: Column, registers: Column, definitions: Column, bad_params: Column) -> Column:
    """(op, params, qubits, clbits, problem) of a statement, a row for each index of whole registers; without arguments one row all the same."""
    c = s["call"]

    def placed(args: Column) -> Column:
        sizes = F.array_distinct(F.transform(F.filter(args, lambda a: a["whole"]), lambda a: F.size(a["wires"])))
        n_args, n_params = F.size(args), F.size(c["params"])
        kinds = F.array_join(F.transform(args, lambda a: F.coalesce(F.substring(a["kind"], 1, 1), F.lit("?"))), "")
        longest = F.coalesce(F.array_max(F.transform(args, lambda a: F.size(a["wires"]))), F.lit(1))
        times = F.when(c["op"] == "barrier", F.lit(1)).otherwise(F.greatest(F.lit(1), longest))
        used = lambda kind, i: F.flatten(F.transform(F.filter(args, lambda a: a["kind"] == kind), lambda a: F.when(
            (c["op"] == "barrier") | ~a["whole"], a["wires"]).otherwise(F.slice(a["wires"], i + 1, 1))))
        unguarded = (s["guard"] != "") & ~F.exists(registers, lambda r: (r["name"] == s["guard"]) & (r["kind"] == "creg") & (r["at"] < s["at"]))
        # a signature of null arguments is any number of them
        special = F.expr("map('measure', named_struct('params', 0, 'wires', 2, 'kinds', '^qc$'), 'reset', named_struct('params', 0, 'wires', 1, 'kinds', '^q$'), "
                         "'barrier', named_struct('params', 0, 'wires', cast(null as int), 'kinds', '^q+$'))")
        of_gate = bind(_signature(c["op"], definitions, s["at"]), lambda g: F.when(
            g.isNotNull(), F.struct(g["params"].alias("params"), g["wires"].alias("wires"), F.lit("^q*$").alias("kinds"))))

        def judged(g: Column) -> Column:
            return (F.when(s["text"].rlike(r"^(qreg|creg|gate|opaque|if)\b") | (c["op"] == "") | ((c["op"] == "measure") & ~s["arrow"] & ((n_args != 1) | s["text"].contains("->"))), "bad_statement")
                    .when(unguarded, "unknown_argument").when(g.isNull(), "unknown_gate").when((g["params"] != n_params) | (F.coalesce(g["wires"], n_args) != n_args) | (n_args == 0), "wrong_arity")
                    .when(~F.regexp_like(kinds, g["kinds"]) | F.exists(args, lambda a: F.size(a["wires"]) == 0), "unknown_argument")
                    .when((F.size(sizes) > 1) & (c["op"] != "barrier"), "size_mismatch").when(F.arrays_overlap(c["params"], bad_params), "bad_parameter"))

        def one(problem: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), times - 1), lambda i: bind(used("qreg", i), lambda q: F.struct(
                c["op"].alias("op"), c["params"].alias("params"), q.alias("qubits"), used("creg", i).alias("clbits"),
                F.coalesce(problem, F.when(F.size(F.array_distinct(q)) < F.size(q), "unknown_argument")).alias("problem"))))

        return bind(bind(F.coalesce(F.try_element_at(special, c["op"]), of_gate), judged), one)

    return bind(F.transform(c["args"], lambda a: _argument(a, registers, s["at"])), placed)


def _parse_pieces(pieces: DataFrame) -> DataFrame:
    """``pieces`` (an array of statements' texts, ``__p``) and registers ``__r``, definitions ``__d``, and for each statement its place with what
    it stands for (``__ops``) and what is wrong with it (``__found``)."""
    body = F.filter("__s", lambda s: ~s["text"].rlike(_REGISTER) & ~s["text"].rlike(_DEFINITION))
    calls = F.concat(F.transform("__c", lambda s: s["call"]["params"]), F.flatten(F.transform("__f", lambda d: F.transform(d["body"], lambda c: c["params"]))))
    staged = (pieces.withColumn("__s", _statements(F.col("__p")))
              .withColumns({"__r": _registers(F.col("__s")), "__f": _definitions(F.col("__s")), "__c": F.transform(body, _with_call)})
              .withColumn("__bad", F.filter(F.array_distinct(F.flatten(calls)), lambda p: ~E.evaluate(p)["valid"]))
              .withColumn("__d", bind(F.col("__bad"), lambda bad: _checked(F.col("__f"), bad)))
              .withColumn("__ops", bind(F.struct("__r", "__d", "__bad"), lambda k: F.transform("__c", lambda s: F.struct(
                  s["at"].alias("at"), _rows(s, k["__r"], k["__d"], k["__bad"]).alias("rows"))))))
    found = lambda at, what: F.struct(at.alias("at"), what.alias("what"))
    in_calls = F.transform(F.filter("__ops", lambda o: F.exists(o["rows"], lambda r: r["problem"].isNotNull())), lambda o: found(
        o["at"], F.get(F.filter(F.transform(o["rows"], lambda r: r["problem"]), lambda p: p.isNotNull()), 0)))
    in_definitions = F.transform(F.filter("__d", lambda d: ~d["valid"]), lambda d: found(d["at"], F.lit("bad_definition")))
    name = lambda d: F.struct(d["name"].alias("name"), d["at"].alias("at"))
    taken = lambda names: F.transform(F.filter(names, lambda d: F.exists(names, lambda e: (e["name"] == d["name"]) & (e["at"] < d["at"]))), lambda d: found(d["at"], F.lit("duplicate_name")))
    none = F.transform(F.filter("__r", lambda r: r["size"] == 0), lambda r: found(r["at"], F.lit("bad_statement")))
    return staged.withColumn("__found", F.concat(in_calls, in_definitions, bind(F.concat(F.transform("__r", name), F.transform("__d", name)), taken), none))


def _operations(rows: Column) -> Column:
    # calls that have neither a name nor a wire are no operation
    kept = F.filter(rows, lambda o: (o["op"] != "") & (F.size(o["qubits"]) + F.size(o["clbits"]) > 0))
    return F.transform(kept, lambda o, i: F.struct(i.cast("int").alias("pos"), o["op"].alias("op"), o["params"].alias("params"),
                                                   o["qubits"].alias("qubits"), o["clbits"].alias("clbits"))).cast(schemas.OPERATIONS)


def _placed(pieces: Column, declared: Column, declares, item) -> Column:
    """``item`` (of pos, piece, nth) of every piece: its place, its text (null for a declaration) and how many declarations stand before it.

    ``declared`` holds the pieces that are declarations. Where all of them come first, as in most texts, places alone tell the rest.
    """
    def of(k: Column) -> Column:
        # behind the last declaration all stand before
        before = lambda i: F.when(i >= k["last"], k["n"]).otherwise(F.size(F.filter(F.slice(k["are"], 1, i), lambda d: d)))
        return F.transform(k["ps"], lambda p, i: item(i, F.when(~F.get(k["are"], i), p), before(i)))

    marked = lambda ps: F.struct(ps.alias("ps"), F.transform(ps, declares).alias("are"))
    scattered = lambda ps: bind(bind(marked(ps), lambda m: F.struct(m["ps"].alias("ps"), m["are"].alias("are"), F.size(F.filter(m["are"], lambda d: d)).alias("n"), F.when(
        F.array_contains(m["are"], True), F.size(m["are"]) - F.array_position(F.reverse(m["are"]), F.lit(True)).cast("int") + 1).otherwise(0).alias("last"))), of)
    first = lambda k: F.transform(k["ps"], lambda p, i: item(i, F.when(i >= k["n"], p), F.least(i, k["n"])))
    whole = F.struct(pieces.alias("ps"), declared.alias("ds"), F.size(declared).alias("n"))
    return bind(whole, lambda k: F.when(F.slice(k["ps"], F.lit(1), k["n"]) == k["ds"], first(k)).otherwise(scattered(k["ps"])))


def _table(meaning: DataFrame) -> tuple[Column, int] | None:
    """What statements mean as one constant that every task has: buckets of (k, meaning) by ``k``, and their number; none if they are too many, one is too long
    or two have one ``k``."""
    entry = F.struct("__k", F.struct(*[c for c in meaning.columns if c not in ("__k", "__l")]).alias("m"))
    kind = meaning.select(F.array(F.array(entry))).schema[0].dataType
    known = meaning.select("__k", F.when(F.length(F.to_json(entry)) <= MAX_MEANING, F.to_json(entry))).collect()
    if len(known) > MAX_SENT or any(text is None for _, text in known) or len({k for k, _ in known}) < len(known):
        return None
    buckets = [[] for _ in range(max(1, 2 * len(known)))]
    for k, text in known:
        buckets[k % len(buckets)].append(text)
    return F.from_json(F.lit("[" + ",".join("[" + ",".join(b) + "]" for b in buckets) + "]"), kind), len(buckets)


def parse(circuits: DataFrame, definitions: bool = False, expand: bool = False, values: bool = False) -> DataFrame:
    """``circuits`` (with a text column ``qasm``) and num_qubits, num_clbits, ops, problem; with ``definitions`` also the gates that the text defines.

    ``ops``: pos, op, params, qubits, clbits, in order; wires are numbers over all registers of a kind. ``problem`` is null for a valid
    text, else blank, no_header, no_qubits, or what is wrong with its first bad statement: bad_statement (not of the grammar), duplicate_name,
    bad_definition, unknown_gate, wrong_arity (parameters or arguments), unknown_argument (not declared before, of the wrong kind, beyond its register, or
    a qubit twice), size_mismatch (whole registers of different sizes) or bad_parameter. Null texts are blank. Parameters are whole
    expressions with parentheses to any depth, parted at the commas outside of these; names in them that nothing defines are free parameters.
    With ``expand`` the operations are those of :func:`expand_definitions`, with ``values`` also the :func:`parameter_values` of each.

    What a statement means depends on its text and the declarations around it. So each distinct statement is parsed once for each distinct list of declarations,
    as a text of these and itself: work on the grammar grows with distinct statements. A first pass lists and parses these, when the function is called; if they
    are few (MAX_SENT, none longer than MAX_MEANING), every task has them all and each text looks its own up, without a shuffle. More of them are joined to the
    circuits that have them: one join, and one grouping by the text's digest.
    """
    text = F.coalesce("qasm", F.lit(""))
    # whatever may be a declaration; others that hold such a word do no harm
    declares = lambda p: p.contains("qreg") | p.contains("creg") | p.contains("gate") | p.contains("opaque")
    staged = circuits.withColumn("__p", _pieces(text)).withColumn("__context", F.filter("__p", declares))
    placed = lambda item: _placed(F.col("__p"), F.col("__context"), declares, item)
    listed = staged.withColumn("__s", placed(lambda i, piece, nth: F.struct(i.cast("int").alias("pos"), piece.alias("piece"), nth.alias("nth"))))
    exploded = lambda rows, *own: rows.select(*own, "__context", F.explode_outer("__s").alias("s")).where("s IS NOT NULL").select(*own, "__context", "s.*")
    kinds = ["__context", "nth", "piece"]
    # rows travel with two hashes of their statement instead of its text; the first is made of a hash of the declarations, which a text makes once
    key = lambda declared, nth, piece: F.xxhash64(declared, nth, piece)
    digest = (key(F.xxhash64("__context"), F.col("nth"), F.col("piece")), F.xxhash64(F.lit(1), *kinds))
    empty = lambda kind: F.array().cast(kind)

    def meant(statements: DataFrame) -> DataFrame:
        # the statement stands behind those declarations that are before it; a null piece is the declaration at that place itself
        around = F.when(F.col("piece").isNull(), F.col("__context")).otherwise(F.concat(
            F.slice("__context", F.lit(1), F.col("nth")), F.array("piece"), F.slice("__context", F.col("nth") + 1, F.size("__context"))))
        parsed = _parse_pieces(statements.withColumn("__p", around))
        own = lambda items: F.filter(items, lambda o: o["at"] == F.col("nth"))
        meaning = parsed.select(*kinds, _total(F.col("__r"), "qreg").alias("n_q"), _total(F.col("__r"), "creg").alias("n_c"), F.array_min(own("__found"))["what"].alias("what"),
                                F.col("__d").alias("definitions"), _operations(F.flatten(F.transform(own("__ops"), lambda o: o["rows"]))).alias("ops"))
        if expand:
            meaning = expand_definitions(meaning)
        if values:
            meaning = meaning.withColumn("values", parameter_values())
        k, l = digest
        return meaning.select(k.alias("__k"), l.alias("__l"), "n_q", "n_c", "what", "ops", *(["definitions"] if definitions else []), *(["values"] if values else []))

    def finished(whole: DataFrame, n_qubits: Column, n_clbits: Column, what: Column, kept: Column, defined: Column | None) -> DataFrame:
        problem = (F.when(~text.rlike(r"\S"), "blank").when(~text.rlike(r"(?s)^(?:\s|//[^\n]*\n)*+OPENQASM\s+2\.0\s*;"), "no_header")
                   .when(n_qubits == 0, "no_qubits").otherwise(what))
        # a place that may be null, as the schema has it: a cast would copy every operation
        ops = F.transform(F.flatten(F.transform(kept, lambda m: m["ops"])), lambda o, i: F.struct(
            F.when(i >= 0, i.cast("int")).alias("pos"), o["op"].alias("op"), o["params"].alias("params"), o["qubits"].alias("qubits"), o["clbits"].alias("clbits")))
        found = {"num_qubits": n_qubits, "num_clbits": n_clbits, "ops": F.coalesce(ops.cast(schemas.OPERATIONS), empty(schemas.OPERATIONS)), "problem": problem}
        if definitions:
            found["definitions"] = F.coalesce(defined, empty(_DEFINITIONS))
        if values:
            found["values"] = F.coalesce(F.flatten(F.transform(kept, lambda m: m["values"])), empty("array<array<double>>"))
        return whole.withColumns(found)

    distinct = exploded(listed).select(*kinds).distinct()
    table = None if circuits.isStreaming else _table(meant(distinct.limit(MAX_SENT + 1)))
    if table:
        known, n_buckets = table

        def looked_up(k: Column) -> Column:
            bucket = F.get(known, F.pmod(k, F.lit(n_buckets)).cast("int"))
            return F.coalesce(F.get(F.filter(bucket, lambda e: e["__k"] == k), 0)["m"], F.raise_error(F.lit("a circuit has changed since its statements were listed")))

        keys = bind(F.xxhash64("__context"), lambda h: placed(lambda i, piece, nth: key(h, nth, piece)))
        said = F.transform(keys, looked_up)
        first = lambda c: F.get(F.col("__said"), F.lit(0))[c]
        what = F.get(F.filter("__said", lambda m: m["what"].isNotNull()), F.lit(0))["what"]
        return finished(staged.withColumn("__said", said), F.coalesce(first("n_q"), F.lit(0)), F.coalesce(first("n_c"), F.lit(0)), what, F.col("__said"),
                        first("definitions") if definitions else None).drop("__p", "__context", "__said")
    meaning = meant(distinct)
    hashed = F.unhex(F.md5(text))
    k, l = digest
    met = exploded(listed.withColumn("__text", hashed), "__text").select("__text", "pos", k.alias("__k"), l.alias("__l")).join(meaning, ["__k", "__l"])
    # equal texts are one: their statements repeat, and the set holds each once
    whole = met.groupBy("__text").agg(
        F.max("n_q").alias("__n_q"), F.max("n_c").alias("__n_c"), F.min(F.when(F.col("what").isNotNull(), F.struct("pos", "what")))["what"].alias("__what"),
        F.array_sort(F.collect_set(F.struct("pos", "ops", *(["values"] if values else [])))).alias("__said"), *([F.first("definitions").alias("__defined")] if definitions else []))
    joined = circuits.withColumn("__text", hashed).join(whole, "__text", "left")
    return finished(joined, F.coalesce("__n_q", F.lit(0)), F.coalesce("__n_c", F.lit(0)), F.col("__what"), F.col("__said"), F.col("__defined") if definitions else None).drop(
        "__text", "__n_q", "__n_c", "__what", "__said", "__defined")


def parse_each(circuits: DataFrame) -> DataFrame:
    """:func:`parse` text by text: no join and no shuffle, and ``circuits`` is read once, but every statement is parsed wherever it stands."""
    text = F.coalesce("qasm", F.lit(""))
    staged = _parse_pieces(circuits.withColumn("__p", _pieces(text)))
    problem = (F.when(~text.rlike(r"\S"), "blank").when(~text.rlike(r"(?s)^(?:\s|//[^\n]*\n)*+OPENQASM\s+2\.0\s*;"), "no_header")
               .when(_total(F.col("__r"), "qreg") == 0, "no_qubits").otherwise(F.array_min("__found")["what"]))
    return staged.withColumns({"num_qubits": _total(F.col("__r"), "qreg"), "num_clbits": _total(F.col("__r"), "creg"), "ops": _operations(F.flatten(F.transform("__ops", lambda o: o["rows"]))),
                               "problem": problem}).drop("__p", "__s", "__r", "__f", "__c", "__bad", "__d", "__ops", "__found")


def expand_definitions(parsed: DataFrame) -> DataFrame:
    """The result of ``parse(definitions=True)`` with every call of a defined gate replaced by its body, until only gates without a body are left.

    A body calls earlier definitions only, so the definitions are expanded in their order, one fold, and each call is then
    replaced once. Parameters are put into the body's expressions as text, in parentheses where needed. Opaque gates stay; an invalid
    definition is not expanded. The result is as long as the circuit that the definitions stand for.
    """
    def replaced(op: Column, params: Column, wires: Column, known: Column) -> Column:
        as_is = F.array(F.struct(op.alias("op"), params.alias("params"), wires.alias("wires")))
        hit = F.get(F.filter(known, lambda d: d["name"] == op), 0)
        return bind(hit, lambda d: F.when(d.isNull(), as_is).otherwise(F.transform(d["body"], lambda b: F.struct(
            b["op"].alias("op"), F.transform(b["params"], lambda p: E.substituted(p, d["params"], params)).alias("params"),
            F.transform(b["wires"], lambda w: F.get(wires, w)).alias("wires")))))

    def flat(acc: Column, d: Column) -> Column:
        number = lambda a: (F.array_position(d["wires"], a) - 1).cast("int")
        body = F.flatten(F.transform(d["body"], lambda c: replaced(c["op"], c["params"], F.transform(c["args"], number), acc)))
        return F.concat(acc, F.array(F.struct(d["name"].alias("name"), d["params"].alias("params"), body.alias("body"))).cast(_FLAT))

    usable = F.filter("definitions", lambda d: d["valid"] & ~d["opaque"])
    known = F.aggregate(usable, F.array().cast(_FLAT), flat)
    calls = bind(known, lambda k: F.flatten(F.transform("ops", lambda o: F.transform(replaced(o["op"], o["params"], o["qubits"], k), lambda r: F.struct(
        r["op"].alias("op"), r["params"].alias("params"), r["wires"].alias("qubits"), o["clbits"].alias("clbits"))))))
    ops = F.transform(calls, lambda o, i: F.struct(i.cast("int").alias("pos"), o["op"].alias("op"), o["params"].alias("params"), o["qubits"].alias("qubits"), o["clbits"].alias("clbits")))
    return parsed.withColumn("ops", ops.cast(schemas.OPERATIONS))


def parameter_values(ops: Column | str = "ops") -> Column:
    """For each operation the values of its parameters; null for free ones. Two spellings of one angle have one value."""
    return F.transform(ops, lambda o: F.transform(o["params"], E.value))


def explode_ops(parsed: DataFrame, key: str = "name") -> DataFrame:
    return _one_each(parsed, key).select(key, "o.*")


def _one_each(parsed: DataFrame, *keep: str) -> DataFrame:
    """(keep, o), a row for each operation. An outer explode: before a plain one Spark would filter by the array's size, i.e. parse twice."""
    return parsed.select(*keep, F.explode_outer("ops").alias("o")).where("o IS NOT NULL")


def sequence_key(ops: Column | str = "ops") -> Column:
    """Equal for circuits of the same operations on the same wires in order, whatever their parameters: such circuits belong on one side of a split."""
    wires = lambda w: F.array_join(w.cast("array<string>"), ",")
    return F.sha2(F.array_join(F.transform(ops, lambda o: F.concat_ws(" ", o["op"], wires(o["qubits"]), wires(o["clbits"]))), ";"), 256)


def _counted(ops: Column | str = "ops") -> Column:
    """(op, n) of each name that operations have."""
    return bind(F.transform(ops, lambda o: o["op"]), lambda names: F.transform(F.array_distinct(names), lambda op: F.struct(
        op.alias("op"), F.size(F.filter(names, lambda n: n == op)).cast("long").alias("n"))))


def op_counts(parsed: DataFrame, key: str = "name") -> DataFrame:
    """(key, op, n): operations by name. Each row counts its own, and only the counts are shuffled."""
    own = parsed.select(key, F.explode_outer(_counted()).alias("c")).where("c IS NOT NULL").select(key, "c.*")
    return own.groupBy(key, "op").agg(F.sum("n").alias("n"))


def _two_qubit(o: Column) -> Column:
    return (F.size(o["qubits"]) == 2) & ~o["op"].isin(*NOT_GATES)


def critical_path(ops: Column, n_wires: Column) -> Column:
    """(depth, two): length of the longest chain over shared qubits and clbits, and the most two-qubit gates that a
    longest chain has. A barrier joins its wires and adds nothing. A level is one number, the depth before its lower 32 bits."""
    start = F.array_repeat(F.lit(0).cast("long"), F.greatest(n_wires, F.lit(1)))

    def step(levels: Column, o: Column) -> Column:
        top = F.aggregate(o["wires"], F.lit(0).cast("long"), lambda best, w: F.greatest(best, F.get(levels, w)))
        put = lambda level, old, w: F.concat(F.slice(old, F.lit(1), w), F.array(level), F.slice(old, w + 2, F.size(old)))
        return bind(top + o["adds"], lambda level: F.aggregate(o["wires"], levels, lambda old, w: put(level, old, w)))

    adds = lambda o: o["layer"].cast("long") * F.lit(1 << 32) + o["pair"].cast("long")
    counted = F.transform(ops, lambda o: F.struct(o["wires"].alias("wires"), adds(o).alias("adds")))
    return bind(F.array_max(F.aggregate(counted, start, step)), lambda m: F.struct(
        F.shiftright(m, 32).cast("int").alias("depth"), m.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("two")))


def features(parsed: DataFrame) -> DataFrame:
    """``parsed`` and depth, size and the published SupermarQ features, each between 0 and 1.

    program_communication: mean degree of the qubit interaction graph over n - 1. critical_depth: two-qubit gates on a longest
    path over all two-qubit gates (the path with most of them). entanglement_ratio: two-qubit gates over gates.
    parallelism: (gates / depth - 1) / (n - 1). liveness: share of qubit-layers in which a gate, measurement or reset acts.
    Depth counts every operation but barriers; gates leave out measure and reset.
    """
    wires = bind(F.col("num_qubits"), lambda n: F.transform("ops", lambda o: F.struct(
        F.concat(o["qubits"], F.transform(o["clbits"], lambda c: c + n)).alias("wires"),
        F.when(o["op"] == "barrier", 0).otherwise(1).alias("layer"), F.when(_two_qubit(o), 1).otherwise(0).alias("pair"))))
    path = critical_path(wires, F.col("num_qubits") + F.col("num_clbits"))
    n = F.col("num_qubits").cast("double")
    gates = F.size(F.filter("ops", lambda o: ~o["op"].isin(*NOT_GATES))).cast("double")
    two = F.size(F.filter("ops", _two_qubit)).cast("double")
    edges = F.size(F.array_distinct(F.transform(F.filter("ops", _two_qubit), lambda o: F.array_sort(o["qubits"])))).cast("double")
    active = F.aggregate("ops", F.lit(0), lambda t, o: t + F.when(o["op"] == "barrier", 0).otherwise(F.size(o["qubits"]))).cast("double")
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))
    depth = F.col("__path.depth")
    return (parsed.withColumn("__path", path).withColumns({
        "depth": depth, "size": F.size(F.filter("ops", lambda o: o["op"] != "barrier")),
        "program_communication": ratio(2 * edges, n * (n - 1)), "critical_depth": ratio(F.col("__path.two").cast("double"), two),
        "entanglement_ratio": ratio(two, gates), "parallelism": F.when(depth > 0, F.greatest(F.lit(0.0), ratio(ratio(gates, depth.cast("double")) - 1, n - 1))).otherwise(F.lit(0.0)),
        "liveness": ratio(active, n * depth)}).drop("__path"))


def gate_count_features(parsed: DataFrame, gates: list[str], key: str = "name") -> DataFrame:
    """One column ``gate_count_<name>`` for each named gate; gates that do not occur are 0. A row for each of ``parsed``; rows of one key count together, rows without a key nothing."""
    names = parsed.select(key, F.transform("ops", lambda o: o["op"]).alias("__names"))
    own = names.select(key, *[F.size(F.filter("__names", lambda n: n == g)).alias(f"gate_count_{g}") for g in gates])
    total = lambda c: F.when(F.col(key).isNull(), F.lit(0).cast("long")).otherwise(F.sum(c).over(Window.partitionBy(key)))
    return own.select(key, *[total(f"gate_count_{g}").alias(f"gate_count_{g}") for g in gates])


def feature_map(with_features: DataFrame) -> DataFrame:
    """The result of :func:`features` with ``features``: FEATURE_NAMES to numbers, gates that don't occur at 0."""
    names = F.transform("ops", lambda o: o["op"])
    gates = F.transform(F.array(*[F.lit(g) for g in GATES]), lambda g: F.size(F.filter(names, lambda n: n == g)).cast("double"))
    values = F.concat(gates, F.array(*[F.col(c).cast("double") for c in SHAPE_FEATURES]))
    return with_features.withColumn("features", F.map_from_arrays(F.array(*[F.lit(n) for n in FEATURE_NAMES]), values))


def n_parameters(ops: Column) -> Column:
    """How many free parameters operations have: names that stand for no function or constant."""
    return F.size(F.array_distinct(F.flatten(F.transform(ops, lambda o: F.flatten(F.transform(o["params"], E.free_names))))))


def summary(parsed: DataFrame, key: str = "name") -> DataFrame:
    """(key, num_qubits, num_clbits, depth, size, num_parameters, op_counts sorted by name). Rows of one key have the counts of them all; without a key or an operation there are none.

    ``parsed`` is read once, and rows meet by their key without their operations.
    """
    shown = ["num_qubits", "num_clbits", "depth", "size", "num_parameters"]
    rows = features(parsed).select(key, *shown[:4], n_parameters(F.col("ops")).alias("num_parameters"), _counted().alias("__counted"))
    # rows without a key are no group: each stays by itself
    met = rows.withColumn("__alone", F.when(F.col(key).isNull(), F.monotonically_increasing_id())).groupBy(key, "__alone").agg(
        F.collect_list(F.struct(*shown)).alias("__rows"), F.flatten(F.collect_list("__counted")).alias("__all"))
    total = bind(F.col("__all"), lambda items: F.transform(F.array_sort(F.array_distinct(F.transform(items, lambda c: c["op"]))), lambda op: F.struct(
        op.alias("op"), F.aggregate(F.filter(items, lambda c: c["op"] == op), F.lit(0).cast("long"), lambda t, c: t + c["n"]).alias("n"))))
    counts = F.when(F.col(key).isNotNull() & (F.size("__all") > 0), F.map_from_entries(total))
    return met.withColumn("op_counts", counts).select(key, "op_counts", F.explode("__rows").alias("r")).select(key, *[f"r.{c}" for c in shown], "op_counts")


def to_text(ops: Column, num_qubits: Column, num_clbits: Column) -> Column:
    """OpenQASM 2 text of operations over one register ``q`` and one ``c``."""
    join = lambda wires, r: F.array_join(F.transform(wires, lambda w: F.concat(F.lit(r + "["), w.cast("string"), F.lit("]"))), ",")
    line = lambda o: F.concat(o["op"], F.when(F.size(o["params"]) > 0, F.concat(F.lit("("), F.array_join(o["params"], ","), F.lit(")"))).otherwise(""),
                              F.lit(" "), join(o["qubits"], "q"), F.when(F.size(o["clbits"]) > 0, F.concat(F.lit(" -> "), join(o["clbits"], "c"))).otherwise(""), F.lit(";"))
    head = F.concat(F.lit('OPENQASM 2.0;\ninclude "qelib1.inc";\nqreg q['), num_qubits.cast("string"), F.lit("];\n"))
    clbits = F.when(num_clbits > 0, F.concat(F.lit("creg c["), num_clbits.cast("string"), F.lit("];\n"))).otherwise("")
    return F.concat(head, clbits, F.array_join(F.transform(ops, line), "\n"), F.lit("\n"))


def verify_compiled(parsed: DataFrame, devices: DataFrame, edges: DataFrame, device: str = "device", directed: bool = False,
                    errors: Column | None = None) -> DataFrame:
    """``parsed`` (one row for a circuit and device) and unsupported, native_basis, fits_coupling, executable.

    Barriers are always supported. A two-qubit gate fits if its pair is an edge, in either direction unless ``directed``, or if
    the device couples all to all; a device without edges that does not say so has no pair. ``errors``: a list of
    validator errors that also forbids execution. A device that the catalog lacks supports nothing.
    """
    coupling = edges.groupBy("device_id").agg(F.collect_set(F.struct("src", "dst")).alias("__edges"))
    known = devices.select(F.col("device_id").alias(device), F.col("operation_names").alias("__names"), F.col("all_to_all").alias("__all")).join(
        coupling.withColumnRenamed("device_id", device), device, "left")
    used = F.array_distinct(F.filter(F.transform("ops", lambda o: o["op"]), lambda o: o != "barrier"))
    pair = lambda a, b: F.array_contains("__edges", F.struct(a.alias("src"), b.alias("dst")))
    on_edge = lambda o: F.coalesce(pair(o["qubits"][0], o["qubits"][1]) | (F.lit(not directed) & pair(o["qubits"][1], o["qubits"][0])), F.lit(False))
    joined = parsed.join(known, device, "left").withColumns({
        "unsupported": F.array_sort(F.array_except(used, F.coalesce("__names", F.array().cast("array<string>")))),
        "fits_coupling": F.coalesce("__all", F.lit(False)) | F.forall(F.filter("ops", _two_qubit), on_edge)})
    return joined.withColumn("native_basis", F.size("unsupported") == 0).withColumn(
        "executable", F.col("native_basis") & F.col("fits_coupling") & (F.size(errors) == 0 if errors is not None else F.lit(True))).drop("__names", "__all", "__edges")


def synthesis_limit(operations: DataFrame, key: str = "device_id") -> DataFrame:
    """(key, limit): 3 where an operation other than barrier and measure acts on three qubits, else 2. Needs name, num_qubits."""
    wide = F.max(F.when(~F.col("name").isin("barrier", "measure") & (F.col("num_qubits") == 3), 1).otherwise(0))
    return operations.groupBy(key).agg((wide + 2).alias("limit"))


def _distinct_instructions(instructions: DataFrame, device: str, *values: str) -> DataFrame:
    """One row for each (device, name, qubits): rows that repeat one are taken once; of differing ones the greatest values hold, null before any."""
    worst = lambda c: F.when(F.count(c) == F.count("*"), F.max(c)).alias(c)
    return instructions.groupBy(F.col("device_id").alias(device), F.col("name").alias("name_"), "qubits").agg(*[worst(c) for c in values])


def expected_fidelity(compiled: DataFrame, instructions: DataFrame, device: str = "device", key: str = "name") -> DataFrame:
    """(key, device, score): product of 1 - error over the operations, by name and qubits; barriers count nothing.

    An operation without a known error makes the score null. Instruction rows that repeat count once. Factors are multiplied in sorted order.
    """
    ops = _one_each(compiled, key, device).where("o.op != 'barrier'").select(
        key, device, F.col("o.op").alias("name_"), F.col("o.qubits").alias("qubits"))
    errors = _distinct_instructions(instructions, device, "error")
    factors = ops.join(errors, [device, "name_", "qubits"], "left").groupBy(key, device).agg(
        F.array_sort(F.collect_list(1 - F.col("error"))).alias("f"), F.count("*").alias("n"))
    return factors.select(key, device, F.when(F.size("f") == F.col("n"), F.aggregate("f", F.lit(1.0), lambda a, x: a * x)).alias("score"))


def schedule(timed: Column, num_qubits: Column) -> Column:
    """(length, idle) of operations (op, qubits, duration) in order, each started as soon as all its qubits are free.

    A barrier takes no time and holds its qubits until the last of them is free. ``idle``: for each qubit the time between its
    operations in which none acts on it; before its first and behind its last it is in no superposition that could decay.
    """
    start = F.transform(F.sequence(F.lit(1), F.greatest(num_qubits, F.lit(1))), lambda _: F.expr(
        "named_struct('free', 0.0D, 'ended', cast(null as double), 'idle', 0.0D)"))

    def step(clocks: Column, o: Column) -> Column:
        begin = F.aggregate(o["qubits"], F.lit(0.0), lambda t, w: F.greatest(t, F.get(clocks, w)["free"]))
        acts = o["op"] != "barrier"

        def after(b: Column) -> Column:
            end = b + F.when(acts, o["duration"]).otherwise(F.lit(0.0))
            return F.transform(clocks, lambda c, w: F.when(F.array_contains(o["qubits"], w), F.struct(
                end.alias("free"), F.when(acts, end).otherwise(c["ended"]).alias("ended"),
                (c["idle"] + F.when(acts & c["ended"].isNotNull(), b - c["ended"]).otherwise(F.lit(0.0))).alias("idle"))).otherwise(c))

        return bind(begin, after)

    return F.aggregate(timed, start, step, lambda clocks: F.struct(
        F.array_max(F.transform(clocks, lambda c: F.coalesce(c["ended"], F.lit(0.0)))).alias("length"), F.transform(clocks, lambda c: c["idle"]).alias("idle")))


def estimated_success_probability(compiled: DataFrame, instructions: DataFrame, qubits: DataFrame, device: str = "device", key: str = "name") -> DataFrame:
    """(key, device, length, idle, score): product of 1 - error over the operations, times exp(-idle / min(t1, t2)) of every qubit.

    ``compiled``: a row for each circuit and device with ops and num_qubits; ``instructions``: error and duration_seconds by device, name and qubits;
    ``qubits``: device_id, qubit, t1, t2 in seconds. The schedule is :func:`schedule`'s. Barriers have no error. An operation without a known error or
    duration makes length, idle and score null; a qubit that idles without a known t1 or t2 makes the score null. Rows that
    repeat an instruction count once. A circuit's operations meet in one task twice, to be timed and to be scheduled; instructions are
    joined by device, name and qubits.
    """
    timing = _distinct_instructions(instructions, device, "error", "duration_seconds")
    o = _one_each(compiled, key, device, "num_qubits").select(
        key, device, "num_qubits", F.col("o.pos").alias("pos"), F.col("o.op").alias("name_"), F.col("o.qubits").alias("qubits"))
    one = F.struct("pos", F.col("name_").alias("op"), "qubits", F.col("duration_seconds").alias("duration"), (1 - F.col("error")).alias("factor"))
    timed = (o.join(timing, [device, "name_", "qubits"], "left").groupBy(key, device).agg(F.max("num_qubits").alias("n"), F.array_sort(F.collect_list(one)).alias("timed")))
    acting = F.filter("timed", lambda x: x["op"] != "barrier")
    known = F.forall(acting, lambda x: x["duration"].isNotNull() & x["factor"].isNotNull())
    both = F.when(F.count("t1") + F.count("t2") == 2 * F.count("*"), F.min(F.least("t1", "t2"))).alias("t")  # of rows that repeat a qubit the shortest
    decay = (qubits.groupBy("device_id", "qubit").agg(both).groupBy(F.col("device_id").alias(device))
             .agg(F.map_from_entries(F.collect_list(F.struct(F.col("qubit").cast("int"), "t"))).alias("__t")))
    planned = timed.withColumn("s", F.when(known, schedule(F.col("timed"), F.col("n")))).join(decay, device, "left")
    factors = F.aggregate(F.array_sort(F.transform(acting, lambda x: x["factor"])), F.lit(1.0), lambda a, x: a * x)
    waits = F.transform("s.idle", lambda t, w: F.when(t > 0, t / F.try_element_at("__t", w)).otherwise(F.lit(0.0)))
    lost = F.aggregate(waits, F.lit(0.0), lambda a, x: a + x)
    return planned.select(key, device, F.col("s.length").alias("length"), F.col("s.idle").alias("idle"), (factors * F.exp(-lost)).alias("score"))


def critical_depth_score(features_: DataFrame) -> DataFrame:
    return features_.withColumn("score", 1 - F.col("critical_depth"))
