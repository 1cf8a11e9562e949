from datetime import datetime, timedelta

from pyspark.sql import functions as F

from weftgraph.operators import profile as pr
from weftgraph.operators.drift import alias_table, catalogue, header_cells, lifespans, one_table, schema_changes

NODES = "row_id bigint, load_no int, `name:string:users` string, age string, f0_cell string, load string"


def nodes(spark, rows):
    return spark.createDataFrame([(i, a, b, c, "x", "y") for i, (a, b, c) in enumerate(rows)], NODES)


def test_states_metrics_and_changes(spark):
    rows = [(1, "Ab Cd", "10")] * 9 + [(1, None, "")] + [(2, "Ab Cd", "200")] * 5 + [(2, "ab cd", "x")] * 4 + [(2, "", None)] + [(4, "Ab  Cd", "-1")] + [(None, "Éa O'B-c", "7")]
    table = nodes(spark, rows)
    states = pr.scan_states(table, "nodes", [pr.AGE, pr.NAME])
    got = {(r.field_name, r.load_no, r.measure_name): r.value for r in pr.metrics(states).collect()}
    assert got[("age", 1, "null_rate")] == 0.1 and got[("age", 1, "mean")] == 10 and got[("age", 2, "bad_rate")] == 4 / 9 and got[("age", 2, "out_rate")] == 1
    assert ("age", 2, "mean") not in got  # nothing in range
    assert got[("name:string:users", 1, "distinct_rate")] == 1 / 9 and got[("name:string:users", None, "mean")] == 8
    measured = pr.metrics(states)
    found = {(r.field_name, r.load_no, r.measure_name) for r in pr.changes(measured, pr.limits_table(measured, "nodes", [pr.AGE, pr.NAME])).collect()}
    assert found == {("age", 2, "bad_rate"), ("age", 2, "out_rate"), ("name:string:users", 2, "bad_rate"), ("name:string:users", 2, "distinct_rate")}
    assert pr.metrics(pr.scan_states(table.where("false"), "nodes", [pr.AGE])).count() == 0


def test_sketch_states_merge(spark):
    table = nodes(spark, [(1, f"A{'b' * i} C", str(i)) for i in range(50)] + [(2, None, "1.5")] * 3)
    whole = pr.scan_states(table, "n", [pr.AGE], sketch=True)
    parts = pr.scan_states(table.where("row_id % 2 = 0"), "n", [pr.AGE], sketch=True).unionByName(pr.scan_states(table.where("row_id % 2 = 1"), "n", [pr.AGE], sketch=True))
    show = lambda s: sorted(map(tuple, pr.merge_states(s).selectExpr("load_no", "n_rows", "n_good", "total", "lowest", "highest", "form_whole", "form_real", "hll_sketch_estimate(sketch)").collect()))
    assert show(whole) == show(parts)
    done = {(r.field_name, r.load_no): r for r in pr.profile(table, "n", ("load_no",)).collect()}
    assert len(done) == 2 * 5
    age, word = done[("age", 2)], done[("f0_cell", 2)]
    assert (age.form_shift, age.changed, done[("age", 1)].form_shift, done[("age", 1)].changed) == (1.0, True, None, False)
    assert (word.form_shift, word.changed) == (0.0, False) and done[("name:string:users", 2)].changed  # all null


def test_history_reads_only_new_loads(spark, tmp_path):
    rows = [(k, f"Ab C{'abcdefgh'[i % (k + 2)]}", str(i)) for k in (1, 2, 3) for i in range(8)] + [(None, "Ab Cd", "1")]
    table, checks = nodes(spark, rows), [pr.AGE, pr.NAME]
    show = lambda s: sorted(map(tuple, s.selectExpr("coalesce(load_no, -1)", "field_name", "n_rows", "n_good", "total", "n_distinct").collect()))
    kept = pr.History(spark, str(tmp_path), "nodes", checks)
    kept.refresh(table.where("load_no < 3"))
    again = pr.History(spark, str(tmp_path), "nodes", checks)
    read_again = F.when(F.col("load_no") < 3, F.raise_error(F.lit("read again")).cast("string")).otherwise(F.col("age"))
    again.refresh(table.where("load_no is not null").withColumn("age", read_again))  # of rows of known loads no cell is looked at
    assert show(again.states()) == show(pr.scan_states(table.where("load_no is not null"), "nodes", checks))
    late = pr.History(spark, str(tmp_path / "late"), "nodes", checks).add(table.where("row_id % 2 = 0")).add(table.where("row_id % 2 = 1"))  # each load in two parts
    assert show(late.states()) == show(pr.scan_states(table, "nodes", checks))
    folder = str(tmp_path / "files")
    table.where("load_no < 3").write.parquet(folder)
    table.where("load_no = 3").write.mode("append").parquet(folder)
    plan = pr.wide_states(spark.read.parquet(folder).where("load_no < 1 or load_no > 2"), checks)._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(LessThan(load_no,1),GreaterThan(load_no,2))]" in plan


def test_one_scan_for_all_checks(spark, tmp_path):
    table = nodes(spark, [(1, "Ab Cd", "10"), (2, "Ab Cd", "90")])
    table.write.parquet(str(tmp_path / "t"))
    kept = pr.History(spark, str(tmp_path / "s"), "nodes", [pr.AGE, pr.NAME]).refresh(spark.read.parquet(str(tmp_path / "t")))
    measured = pr.metrics(kept.states())
    plan = pr.changes(measured, pr.limits_table(measured, "nodes", [pr.AGE, pr.NAME]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1
    scan = pr.wide_states(spark.read.parquet(str(tmp_path / "t")), [pr.AGE, pr.NAME])._jdf.queryExecution().executedPlan().toString()
    assert scan.count("Scan parquet") == 1


def test_control_limits(spark):
    values = [(i, 10.0 + i % 2) for i in range(1, 9)] + [(9, 30.0)]
    measured = spark.createDataFrame([("n", "a", i, "mean", v) for i, v in values], "tbl string, field_name string, load_no int, measure_name string, value double")
    assert {r.load_no for r in pr.control_limits(measured).where("outside").collect()} == {9}
    rows = [(k, str((40 + i % 3) if k < 7 else 60)) for k in range(1, 9) for i in range(30)]
    done = {r.load_no: r for r in pr.profile(spark.createDataFrame(rows, "load_no int, age string"), "n", ("load_no",)).collect()}
    assert "mean" in done[7].outside and done[7].changed and not done[6].outside and not done[6].changed


FILES = "file_no int, file_name string, series string, delim string, header string, arrived_at timestamp_ntz"
LINES = "line_id bigint, file_no int, line_no bigint, line string, series string"


def corpus(spark, files, size=40):
    """Files of series nodes in order; a column's values come from its maker."""
    made, lines = [], []
    for k, (header, makers, delim) in enumerate(files):
        made.append((100 - k, f"f{k}", "nodes", delim, delim.join(header), datetime(2025, 1, 1) + timedelta(days=k)))
        lines += [(1000 * k + i, 100 - k, i + 1, delim.join(m(i + 7 * k) for m in makers), "x") for i in range(size)]
    return spark.createDataFrame(made, FILES), spark.createDataFrame(lines, LINES)


def firm(i):
    return ["Buvu Works", "Lebe Press", "Zoke Lab", ""][i * i % 4]


def town(i):
    return ["Demiby", "Gofaby", "Sizaby"][i % 3]


def day(i):
    return f"20{i % 90 + 10}-0{i % 9 + 1}-1{i % 9}"


def name(i):
    return f"{'ABCDEFGHIJ'[i % 10]}{'aeiou'[i % 5]}n K{'aeiou'[i // 5 % 5]}v{'aeiou'[i // 25 % 5]}"


def changes(spark, files):
    return sorted((100 - r.file_no, r.field_name, r.change_kind) for r in schema_changes(*files).collect())


def test_schema_changes(spark):
    files = corpus(
        spark,
        [
            (["name:string:users", "age", "works_on"], [name, str, firm], "\t"),
            (["works_on", "name:string:people", "age:string"], [firm, name, str], ","),  # order, index and the default type don't count
            (["person", "age:INT", "firm:string_array", "born"], [name, str, firm, day], "|"),
            (["person", "age:int", "town", "since"], [name, str, town, day], "\t"),
            (["person", "age:int"], [name, str], "\t"),
        ],
    )
    assert changes(spark, files) == [
        (2, "age", "retyped"), (2, "born", "added"), (2, "firm", "renamed"), (2, "firm", "retyped"), (2, "person", "renamed"),
        (3, "firm", "removed"), (3, "since", "renamed"), (3, "town", "added"), (4, "since", "removed"), (4, "town", "removed"),
    ]
    spans = {(r.field, r.type, r.first_seq, r.last_seq) for r in lifespans(catalogue(header_cells(files[0]))).collect()}
    assert ("age", "string", 1, 2) in spans and ("age", "int", 3, 5) in spans and ("town", "string", 4, 4) in spans


def test_one_table(spark):
    files = corpus(spark, [(["name", "age", "works_on"], [name, str, firm], "\t"), (["person", "age:int", "works_on:string_array"], [name, str, lambda i: "Buvu Works,Zoke Lab"], "\t")], 5)
    table = spark.createDataFrame([(1, "Cy Ta", "x", "Lebe Press")], "row_id bigint, n string, age string, firm string")
    got = one_table(*files, {"old": (table, {"n": "name", "age": "age", "firm": "works_on"})}, ("nodes",), {"age": "int"})
    assert dict(got.dtypes) == {"origin": "string", "row_key": "bigint", "name": "string", "age": "int", "works_on": "array<string>"}
    rows = {(r.origin, r.row_key): r for r in got.collect()}
    assert len(rows) == 11 and rows[("nodes", 1000)].works_on == ["Buvu Works", "Zoke Lab"] and rows[("nodes", 1000)].name == name(7)
    cells = one_table(*files, {"old": (table, {"n": "name", "age": "age", "firm": "works_on"})}, ("nodes",), {"age": "int"}, unread=True).where("size(unread) > 0").collect()
    assert [(r.origin, r.row_key, [tuple(u) for u in r.unread]) for r in cells] == [("old", 1, [("age", "x")])]
    free = one_table(*files, {}, ("nodes",))
    assert dict(free.dtypes)["age"] == "string" and free.count() == 10  # of a text and an int only a text holds all
    assert rows[("old", 1)].age is None and rows[("old", 1)].works_on == ["Lebe Press"] and rows[("nodes", 2)].age == 2


def test_no_values_no_rename_and_empty_tables(spark):
    files, lines = corpus(spark, [(["a", "b"], [str, day], "\t"), (["a", "c"], [str, day], "\t")])
    assert changes(spark, (files, lines.where("false"))) == [(1, "b", "removed"), (1, "c", "added")]
    assert schema_changes(files.where("false"), lines).count() == 0
    alias, types = alias_table(files, lines, {})
    assert {r.file_no: r.columns for r in alias.collect()} == {100: ["a", "b"], 99: ["a", "b"]} and types == {"a": "string", "b": "string"}


def test_every_measure_of_every_column_moves(spark):
    """Values that shift inside one form class, and moves that only mean, out_rate or distinct rate show."""
    rows = []
    for load in (1, 2, 3):
        for i in range(400):
            second = load == 2
            rows.append((load, str(30 + i % 20 + 10 * second) if load < 3 or i % 4 else "500", "KNOWS" if not second else "OWNS", str((1 + i % 40) * (10 if second else 1)), datetime(2025, 1 + load, 1 + i % 20)))
    table = spark.createDataFrame(rows, "load_no int, age string, c2 string, c4 string, loaded_at timestamp_ntz")
    done = {(r.field_name, r.load_no): r for r in pr.profile(table, "n", ("load_no",)).collect()}
    assert not any(done[f, 1].changed for f in ("age", "c2", "c4", "loaded_at"))
    assert "mean" in done["age", 2].moved and {"mean", "out_rate"} <= set(done["age", 3].moved)
    assert done["c2", 2].moved == ["mean", "value_shift"] and done["c2", 2].form_shift == 0
    assert {"mean", "value_shift"} <= set(done["c4", 2].moved) and (done["c4", 2].mean, done["c4", 2].form_whole) == (205, 400)
    assert "value_shift" in done["loaded_at", 2].moved and sum(b.n for b in done["c4", 2].histogram) == 400
    same = {r.field_name for r in pr.profile(table.where("load_no = 1").unionByName(table.where("load_no = 1").selectExpr("2 as load_no", "age", "c2", "c4", "loaded_at")), "n", ("load_no",)).where("changed").collect()}
    assert same == set()
    halves = pr.merge_bins(pr.scan_bins(table.where("c4 < '3'"), "n", [pr.COUNTER]).unionByName(pr.scan_bins(table.where("c4 >= '3'"), "n", [pr.COUNTER])))
    assert sorted(halves.collect()) == sorted(pr.scan_bins(table, "n", [pr.COUNTER]).collect())


def test_ranges_are_of_typed_values(spark):
    at = [datetime(2025, 1, 9), datetime(2025, 1, 10)]
    rows = [(9999, 1, "9", "9x", "2020-02-30", at[0]), (40000, 1, "100", "500", "2019-12-31", at[1]), (40001, 1, " 42", "9", "1999-1-1", None), (40002, 1, "2147550000", "", "03.04.2001", None), (5, 1, "６９", "-7", "2001-04-03", None)]
    table = spark.createDataFrame(rows, "row_id bigint, load_no int, age string, c4 string, c3 string, loaded_at timestamp_ntz")
    done = {r.field_name: r for r in pr.profile(table, "n", ("load_no",)).collect()}
    whole = {f: (done[f].low_whole, done[f].high_whole) for f in done}
    assert whole == {"row_id": (5, 40002), "age": (9, 100), "c4": (-7, 500), "c3": (None, None), "loaded_at": (None, None)}
    assert [str(x) for x in (done["c3"].low_day, done["c3"].high_day)] == ["2001-04-03", "2019-12-31"]
    assert (done["loaded_at"].low_time, done["loaded_at"].high_time) == tuple(at) and (done["c4"].lowest, done["c4"].highest) == ("-7", "9x")
    parts = [pr.scan_states(table.where(f"row_id {op} 9999"), "n", [pr.AGE, pr.COUNTER], sketch=True) for op in ("<=", ">")]
    merged = {r.field_name: (r.low_whole, r.high_whole) for r in pr.merge_states(parts[0].unionByName(parts[1])).collect()}
    assert merged == {"age": (9, 100), "c4": (-7, 500)}


def test_one_table_keeps_columns_of_loaded_tables(spark):
    files = corpus(spark, [(["name", "age"], [name, str], "\t")], 2)
    at = datetime(2025, 1, 1)
    nodes = spark.createDataFrame([(1, "A", 3, at, None), (2, "B", 4, at, at)], "row_id bigint, n string, load_no int, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    other = spark.createDataFrame([(1, "C", at)], "row_id bigint, n string, loaded_at timestamp_ntz")
    got = one_table(*files, {"old": (nodes, {"n": "name", "load_no": "load_no", "loaded_at": "loaded_at", "deleted_at": "deleted_at"}), "older": (other, {"n": "name", "loaded_at": "loaded_at"})}, ("nodes",), {"age": "int"})
    assert got.dtypes[2:] == [("age", "int"), ("name", "string"), ("load_no", "int"), ("loaded_at", "timestamp_ntz"), ("deleted_at", "timestamp_ntz")]
    rows = {(r.origin, r.row_key): (r.load_no, r.loaded_at, r.deleted_at) for r in got.collect()}
    assert rows == {("nodes", 0): (None, None, None), ("nodes", 1): (None, None, None), ("old", 1): (3, at, None), ("old", 2): (4, at, at), ("older", 1): (None, at, None)}


def test_two_like_fields_renamed_in_one_file(spark):
    """b is nearer to c than to d, but c is what a became."""
    stock = ["Kaba", "Lebe", "Mido", "Nofu", "Pagu", "Rilo", "Sume", "Tavi", "Vuko", "Zeba", "Hona", "Jupi", "Woda"]
    pick = lambda *at: lambda i: stock[at[i % 10]]
    a, b, d = pick(*range(10)), pick(*range(9), 10), pick(*range(7), 10, 11, 12)
    files = corpus(spark, [(["id", "a", "b"], [str, a, b], "\t"), (["id", "c", "d"], [str, a, d], "\t")])
    assert changes(spark, files) == [(1, "c", "renamed"), (1, "d", "renamed")]
    assert {r.file_no: r.columns for r in alias_table(*files, {})[0].collect()}[99] == ["id", "a", "b"]


def test_whole_numbers_that_a_double_loses(spark):
    files = corpus(spark, [(["n:long"], [lambda i: str(9007199254740992 + i)], "\t"), (["n:double"], [lambda i: f"{i}.5"], "\t")], 3)
    got = one_table(*files, {}, ("nodes",), unread=True)
    assert dict(got.dtypes)["n"] == "double"
    assert sorted((r.row_key, r.unread[0].text) for r in got.where("size(unread) > 0").collect()) == [(1, "9007199254740993"), (2, "9007199254740994")]


def test_renamed_back_and_broken_lives(spark):
    """A field that is renamed and renamed back is one column; one that goes and comes again with other values is too, by its name."""
    files = corpus(spark, [(["id", "name"], [str, name], "\t"), (["id", "person"], [str, name], "\t"), (["id", "name"], [str, name], "\t"), (["id"], [str], "\t"), (["id", "name"], [str, town], "\t")])
    assert changes(spark, files) == [(1, "person", "renamed"), (2, "name", "renamed"), (3, "name", "removed"), (4, "name", "added")]
    assert [r.columns for r in alias_table(*files, {})[0].orderBy("file_no", ascending=False).collect()] == [["id", "name"], ["id", "name"], ["id", "name"], ["id"], ["id", "name"]]
