"""Small worked cases for selection, predicates, functions, changes, catalogs, text forms and graphs."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from larkspur.catalog import Catalog, Field
from larkspur.functions import collections as C
from larkspur.functions import numbers as N
from larkspur.functions import strings as S
from larkspur.functions.typed import typed
from larkspur.operators import change
from larkspur.operators.graph import ALL, Graph, schema_graph
from larkspur.operators.predicates import all_of, any_of, none_of, variant, where
from larkspur.operators.record_graph import record_graph
from larkspur.operators.select import Agg, collect, exact_product, follow, select
from larkspur.sources import dump, tables


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(0, "Ann", 30, True), (1, "Bob", None, False), (2, None, 65, None), (3, "Cid", 70, True)], "_index long, name string, age int, paid boolean")


def ids(df):
    return [r["_index"] for r in df.orderBy("_index").collect()]


@pytest.mark.parametrize(
    ("test", "want"),
    [
        (where("age", ">", 40), [2, 3]),
        (where("age", "!=", 30), [2, 3]),
        (where("age", "=", None), [1]),
        (where("age", "!=", None), [0, 2, 3]),
        (none_of(where("age", ">", 40)), [0, 1]),
        (none_of(all_of(where("age", ">", 40), where("name", "=", "Cid"))), [0, 1, 2]),
        (any_of(where("name", "starts with", "B"), where("name", "matches", "^C.d$")), [1, 3]),
        (where("missing", "=", 1), []),
        (none_of(where("missing", "=", 1)), [0, 1, 2, 3]),
        (where("name", "<", 5), []),
        (where("name", "!=", 5), [0, 1, 3]),
        (where("paid", "=", True), [0, 3]),
    ],
)
def test_predicates(people, test, want):
    assert ids(select(people, "*", test)) == want


def test_pushed_filters(spark):
    part = tables.table(spark, "/root/testdata/sf0.001", "part")
    plan = select(part, ["p_name"], all_of(where("p_size", ">", 10), where("p_brand", "=", "Brand#2")))._jdf.queryExecution().toString()
    assert "GreaterThan(p_size,10)" in plan and "EqualTo(p_brand,Brand#2)" in plan and "p_retailprice" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_selection(people):
    assert [r["name"] for r in select(people, ["name"], sort_by=["age"]).collect()] == ["Bob", "Ann", None, "Cid"]
    assert [r["name"] for r in select(people, ["name"], sort_by=["age"], offset=1, limit=2).collect()] == ["Ann", None]
    assert select(people, ["nobody"]).collect()[0]["nobody"] is None
    got = select(people, [Agg("sum", "age"), Agg("min", "name"), Agg("sum", "paid"), Agg("count", "age"), "name"], sort_by=["age"], limit=3).first()
    assert (got["sum(age)"], got["min(name)"], got["sum(paid)"], got["count(age)"], got["name"]) == (95, None, 1, 3, "Bob")
    grouped = select(people, ["paid", "name", Agg("count")], group_by=["paid"]).collect()
    assert [(r["paid"], r["name"], r["count(*)"]) for r in grouped] == [(True, "Ann", 2), (False, "Bob", 1), (None, None, 1)]


def test_collect_and_follow(spark, people):
    got = collect(people.where("age >= 65"), people.where("_index in (0, 3)")).orderBy("_order")
    assert [r["_index"] for r in got.collect()] == [2, 3, 0]
    pets = spark.createDataFrame([(0, "Rex", 1), (1, "Tom", 9), (2, "Jim", None)], "_index long, pet string, owner long")
    names = follow(pets, [("owner", people, "_index")], "name", "owner_name")
    assert {r["pet"]: r["owner_name"] for r in names.collect()} == {"Rex": "Bob", "Tom": None, "Jim": None}


def test_exact_product(spark):
    df = spark.createDataFrame([("a", 10**18), ("a", 10**18), ("a", 3), ("b", None)], "k string, x long")
    assert {r["k"]: r["product"] for r in exact_product(df, "x", ["k"]).collect()} == {"a": str(3 * 10**36)}
    assert exact_product(df, "x").first()["product"] == str(3 * 10**36)


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return list(row)


def test_strings(spark):
    s, none = F.lit("Hello World"), F.lit(None).cast("string")
    assert one(spark, S.capitalize(F.lit("hELLO wORLD")), S.index_of(s, "o"), S.last_index_of(s, "o"), S.index_of(s, "z"), S.last_index_of(s, "z")) == ["Hello world", 4, 7, -1, -1]
    assert one(spark, S.trim(F.lit(" \t a b \n")), S.pad_start(F.lit("abc"), 2), S.pad_end(F.lit("a"), 3, "."), S.repeat(F.lit("ab"), 0)) == ["a b", "abc", "a..", ""]
    assert one(spark, S.at(s, -1), S.at(s, 99), S.cut(s, -5), S.cut(s, 3, 1), S.cut(s, None, -6), S.sort(F.lit("bca"))) == ["d", None, "World", "", "Hello", "abc"]
    assert one(spark, S.split(F.lit("a.b.."), "."), S.match(s, "(H)(e)"), S.match(s, "x"), S.replace_first(F.lit("aab"), "a", "$1")) == [["a", "b", "", ""], ["He", "H", "e"], None, "$1ab"]
    assert one(spark, S.length(none), S.is_empty(none), S.contains(none, "a"), S.uppercase(none)) == [0, True, False, None]


def test_arrays(spark):
    a, none = F.array(F.lit(3), F.lit(None), F.lit(1), F.lit(3)), F.lit(None).cast("array<int>")
    assert one(spark, C.sort(a), C.sort(a, (None, True)), C.at(a, -4), C.at(a, 4), C.cut(a, -2)) == [[1, 3, 3, None], [None, 3, 3, 1], 3, None, [1, 3]]
    assert one(spark, C.append(none, 1, [2, 3]), C.insert(a, 1, 9), C.insert(a, 99, 9), C.insert(a, -1, 9)) == [[1, 2, 3], [3, 9, None, 1, 3], [3, None, 1, 3, 9], [3, None, 1, 9, 3]]
    assert one(spark, C.remove(a, 3), C.remove_all(a, 3), C.replace_first(a, 3, 0), C.replace_all(a, 3, 0), C.swap(a, 0, -2), C.delete(a, -1)) == [[None, 1, 3], [None, 1], [0, None, 1, 3], [0, None, 1, 0], [1, None, 3, 3], [3, None, 1]]
    assert one(spark, C.length(none), C.is_empty(none), C.contains(none, 1), C.remove(a, 7)) == [0, True, False, [3, None, 1, 3]]
    rows = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(p).alias("p")) for n, p in (("x", 1), ("y", 2), ("z", 2))])
    assert [r["n"] for r in one(spark, C.sort(rows, ("p", True), ("n", False)))[0]] == ["y", "z", "x"]
    with pytest.raises(PySparkException, match="out of range"):
        one(spark, C.delete(a, 4))


def test_sets_and_dicts(spark):
    s, t = F.array(F.lit("b"), F.lit("a")), F.array(F.lit("c"), F.lit("a"))
    assert one(spark, C.set_add(s, "a"), C.set_union(s, t), C.set_intersect(s, t), C.set_difference(s, t), C.set_symmetric_difference(s, t)) == [["b", "a"], ["b", "a", "c"], ["a"], ["b"], ["b", "c"]]
    d = F.create_map(F.lit("k"), F.lit(1), F.lit("l"), F.lit(2))
    assert one(spark, C.has_key(d, "k"), C.lookup(d, "z"), C.drop_key(d, "k"), C.keys(d), C.values(d)) == [True, None, {"l": 2}, ["k", "l"], [1, 2]]


def test_numbers(spark):
    i = F.lit
    assert one(spark, N.floor_div(i(-7), i(2)), N.floor_div(i(7), i(-2)), N.floor_mod(i(-7), i(2)), N.floor_mod(i(7), i(-2)), N.true_div(i(7), i(2))) == [-4, -4, 1, -1, 3.5]
    assert one(spark, N.floor_div(i(7.5), i(0.5)), N.floor_div(i(-7.5), i(2)), N.list_sum(F.array(i(1.5), i(2.5))), N.list_product(F.array(i(1.5), i(1.5))), N.list_sum(F.array(i(1), i(None), i(2)))) == [15, -4, 4.0, 2.25, 3]
    top = i(str(2**64 - 1)).cast("decimal(20,0)")
    assert one(spark, N.multiply(top, i(1), 64, "error", False), N.multiply(top, top, 64, "saturating", False), N.multiply(top, top, 64, "wrapping", False)) == [2**64 - 1, 2**64 - 1, 1]
    none = i(None).cast("string")
    assert one(spark, N.big_compare(none, i("1")), N.fraction_add(N.fraction(none, i(2)), N.fraction(i(1), i(3)))["num"]) == [None, None]
    assert one(spark, N.add(i(127), i(1), 8, "saturating"), N.add(i(127), i(1), 8, "wrapping"), N.subtract(i(0), i(1), 16, "wrapping", False), N.round_half_even(i(2.5))) == [127, -128, 65535, 2.0]
    for bad in (N.add(i(127), i(1), 8), N.convert(i(1.5), 8), N.square_root(i(-1.0)), N.logarithm(i(0.0))):
        with pytest.raises(PySparkException):
            one(spark, bad)
    assert one(spark, N.number_range(3), N.number_range(5, 0, -2), N.number_range(3, 3)) == [[0, 1, 2], [5, 3, 1], []]
    assert one(spark, N.big_multiply(i(str(10**40)), i("-7")), N.big_compare(i("9"), i("10")), N.big_floor_div(i("-7"), i("2"))) == [str(-7 * 10**40), -1, "-4"]
    half = N.fraction_divide(N.fraction(i(1), i(3)), N.fraction(i(2), i(3)))
    assert one(spark, half)[0].asDict() == {"num": "1", "den": "2"}
    assert one(spark, N.half(i(0.1).cast("float")))[0] == pytest.approx(0.0999755859375)
    assert one(spark, N.elementwise(F.array(i(1), i(2)), F.array(i(3), i(4)), lambda x, y: x + y, True, True)) == [[4, 6]]


def test_typed_values(spark):
    c = Catalog()
    c.alias("Tiny", "int8")
    c.enum("Level", {"low": 5, "high": None}, "uint8")
    c.enum("Plain", ["a"])
    x = typed(c, 100, "Tiny")
    assert one(spark, (x + 27).value, (typed(c, 100, "Tiny", "saturating") + 100).value, (100 + typed(c, 100, "int8", "wrapping")).value, (0 - x).value) == [127, 127, -56, -100]
    assert one(spark, (typed(c, -7, "int8") / 2).value, (typed(c, -7, "int8") % 2).value, (typed(c, 7.0, "float64") / 2).value, (x + F.lit(None)).value) == [-4, 1, 3.5, None]
    assert one(spark, (typed(c, F.lit("high"), "Level") * 2).value, x.concat("%")) == [12, "100%"]
    top = typed(c, F.lit(str(2**64 - 1)).cast("decimal(20,0)"), "uint64", "wrapping")
    assert one(spark, (top + 2).value, (top * top).value) == [1, 1]
    for bad in (x + 28, x * 2, typed(c, 128, "int8"), typed(c, -1, "uint8"), typed(c, 1.5, "int8")):
        with pytest.raises(PySparkException):
            one(spark, bad.value)
    for wrong in (lambda: x + typed(c, 1, "int16"), lambda: typed(c, F.lit("a"), "Plain"), lambda: typed(c, "a", "string")):
        with pytest.raises(TypeError):
            wrong()


def test_changes(spark, people):
    older = change.update(people, {"age": F.col("age") + 1}, where("name", "=", "Ann"))
    assert [r["age"] for r in older.orderBy("_index").collect()] == [31, None, 65, 70]
    with pytest.raises(ValueError, match="unknown"):
        change.update(people, {"height": F.lit(1)})
    left = change.delete(people, where("age", ">", 40))
    assert ids(left) == [0, 1]
    numbered, moved = change.compact(change.delete(people, where("name", "=", "Bob")))
    assert ids(numbered) == [0, 1, 2] and sorted((r["old"], r["new"]) for r in moved.collect()) == [(0, 0), (2, 1), (3, 2)]
    more = change.create(people, spark.createDataFrame([("Zoe",), ("Eve",), (None,)], "name string"))
    assert [(r["_index"], r["name"]) for r in more.where("_index > 3").orderBy("_index").collect()] == [(4, "Zoe"), (5, "Eve"), (6, None)]
    assert change.dense_index(people.limit(0), ["name"]).collect() == []


def test_catalog(spark):
    c = Catalog()
    c.interface("Named", [Field("name", "string")])
    c.interface("Aged", [Field("age", "uint8")], ("Named",))
    c.forward("Node")
    c.composite("Person", [Field("friend", "Node"), Field("tags", "{string}"), Field("scores", "{string: float64}")], ("Aged",))
    c.composite("Node", [Field("next", "Node"), Field("of", "Named"), Field("people", "Person[]")])
    c.composite("Boss", [], ("Person",))
    c.enum("Color", ["red", "green"])
    c.enum("Shape", {"none": None, "circle": [Field("r", "float32")]})
    c.enum("Level", {"low": 5, "high": None}, "uint8")
    c.alias("Money", "float64")
    assert c.implementers("Named") == ["Person", "Boss"]
    assert c.schema("Boss").simpleString() == "struct<name:string,age:smallint,friend:bigint,tags:array<string>,scores:map<string,double>>"
    assert c.spark_type("Shape").simpleString() == "struct<_variant:string,circle:struct<r:float>>"
    assert c.types["Level"].variants == {"low": 5, "high": 6}
    assert c.spark_type("Money").simpleString() == "double"
    with pytest.raises(ValueError, match="types"):
        c.composite("Bad", [Field("age", "string")], ("Aged",))
    with pytest.raises(ValueError, match="range"):
        c.enum("Big", {"x": 300}, "uint8")
    assert Catalog.from_json(c.to_json()).to_json() == c.to_json()
    assert {r["name"] for r in c.show(spark, "interface").collect()} == {"Named", "Aged"}
    assert c.describe(spark, "Person").count() == 5


def test_defaults_and_policies(spark):
    c = Catalog()
    c.enum("Shape", {"none": None, "circle": [Field("r", "float64")]})
    c.composite("T", [Field("x", "uint8", 42), Field("y", "int8", None, "wrapping"), Field("l", "int8[]", [0, 1]), Field("s", "Shape", {"_variant": "circle", "circle": {"r": 2.0}})])
    old = spark.createDataFrame([], "_index long, x smallint, y tinyint, l array<tinyint>, s struct<_variant:string,circle:struct<r:double>>")
    got = change.create(old, spark.createDataFrame([(200,), (None,)], "y int"), c, "T").orderBy("_index").collect()
    assert [(r["x"], r["y"], r["l"], r["s"]["_variant"], r["s"]["circle"]["r"]) for r in got] == [(42, -56, [0, 1], "circle", 2.0), (42, None, [0, 1], "circle", 2.0)]
    assert change.create(old, spark.createDataFrame([(None,)], "x int"), c, "T").first()["x"] is None  # a null that is given stays
    small = change.create(old, spark.createDataFrame([(3,)], "x int"), c, "T")
    with pytest.raises(PySparkException, match="out of range"):
        change.create(old, spark.createDataFrame([(300,)], "x int"), c, "T").collect()
    with pytest.raises(PySparkException, match="out of range"):
        change.update(small, {"x": F.lit(-1)}, None, c, "T").collect()
    assert {tuple(r) for r in c.describe(spark, "Shape.circle").collect()} == {("r", "float64", None)}


def test_dump_order(spark):
    c = Catalog()
    c.forward("B")
    c.composite("A", [Field("b", "B")])
    c.composite("B", [Field("a", "A"), Field("n", "string")])
    c.composite("C", [Field("b", "B")])
    assert dump.closure(c, ["C"]) == ["B", "A", "C"]
    assert dump.dump_order(c, ["A", "B", "C"]) == (["B", "A", "C"], [("B", "a", "A")])
    tables_ = {"A": spark.createDataFrame([(0, 1)], "_index long, b long"), "B": spark.createDataFrame([(1, 0, "x")], "_index long, a long, n string")}
    got = [r["value"] for r in dump.dump(c, tables_, "script").orderBy("part", "_index").collect()]
    assert got == ["$_A_0 = create A(b=null)", '$_B_1 = create B(a=$_A_0, n="x")', "update $_A_0 set b=$_B_1"]
    assert [r["value"] for r in dump.dump(c, tables_, "json").orderBy("part").collect()] == ['{"$id":"A_0","b":{"$ref":"B_1"}}', '{"$id":"B_1","a":{"$ref":"A_0"},"n":"x"}']


def test_record_graph_interfaces_sets_and_nothing(spark):
    c = Catalog()
    c.interface("Named", [Field("name", "string")])
    c.composite("Cat", [], ("Named",))
    c.composite("Home", [Field("name", "string"), Field("pet", "Named"), Field("cats", "{Cat}")])
    cats = spark.createDataFrame([(0, "Tom"), (1, "Kit"), (2, None)], "_index long, name string")
    homes = spark.createDataFrame([(0, "H", ("Cat", 1), [("Tom",)]), (1, "I", None, None), (2, "J", ("Dog", 1), [])], "_index long, name string, pet struct<_type:string,_index:long>, cats array<struct<name:string>>")
    g = record_graph(c, {"Cat": cats, "Home": homes}, {"homes": "Home", "cats": "Cat"}, {"pet": ["homes.pet"], "cats": ["homes.cats"], "odd": ["homes.nothing", "unknown.x"]})
    assert {tuple(r) for r in g.edges.collect()} == {("pet", "H", "Kit"), ("cats", "H", "Tom")}
    assert {r["id"] for r in g.nodes.collect()} == {"H", "I", "J", "Tom", "Kit"}


def test_enums(spark):
    shapes = spark.createDataFrame([(0, ("circle", (50.0,))), (1, ("none", None)), (2, ("circle", (5.0,)))], "_index long, bg struct<_variant:string,circle:struct<r:double>>")
    assert ids(select(shapes, "*", variant("bg", "circle", r=5.0))) == [2]
    assert [r["r"] for r in select(tables.variant_scan("Canvas", shapes, "bg", "circle"), "*", where("r", ">", 20.0)).collect()] == [50.0]
    assert [r["value"] for r in tables.enum_overview({"Canvas": shapes}, [("Canvas", "bg")]).orderBy("_index").collect()] == ["circle(r=50.0)", "none", "circle(r=5.0)"]


def test_archive_round_trip(spark, people, tmp_path):
    pets = spark.createDataFrame([(5, "Rex", 3), (6, "Tom", 1)], "_index long, pet string, owner long")
    c = Catalog()
    c.composite("Person", [Field("name", "string")])
    left = change.delete(people, where("name", "=", "Bob"))
    dump.archive(spark, c, {"Person": left, "Pet": pets}, str(tmp_path / "a"), {"Pet": {"owner": "Person"}})
    again, got = dump.restore(spark, str(tmp_path / "a"), ["Person", "Pet"])
    assert again.to_json() == c.to_json()
    assert [(r["_index"], r["pet"], r["owner"]) for r in got["Pet"].orderBy("_index").collect()] == [(0, "Rex", 2), (1, "Tom", None)]


def test_dump_quotes(spark):
    df = spark.createDataFrame([(0, 'a"b\n', ["x"], None)], "_index long, s string, l array<string>, n int")
    assert dump.dump_script(df, "T").first()[0] == '$_T_0 = create T(s="a\\"b\\n", l=["x"], n=null)'
    assert dump.dump_xml(df.select("_index", F.lit("<&").alias("s")), "T").first()[0] == '<T id="T_0"><s>&lt;&amp;</s></T>'


def test_json_documents(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": [1, {"b": "c"}]}\n')
    got = tables.json_documents(spark, str(tmp_path / "x.json")).select(F.try_variant_get("document", "$.a[1].b", "string").alias("b"))
    assert got.first()["b"] == "c"


def test_graph_cycle_ends(spark):
    nodes = spark.createDataFrame([(x, "n", x) for x in "abcd"], "id string, selector string, name string")
    edges = spark.createDataFrame([("next", "a", "b"), ("next", "b", "c"), ("next", "c", "a")], "axis string, source string, target string")
    g = Graph(nodes, edges, {}, {"back": "next"})
    got = g.add(g.select("n", ["a"]), "next", ALL)
    assert got.edges.count() == 3 and got.nodes.count() == 3
    assert g.step(g.select("n", ["a"]), "next", 0).nodes.count() == 0
    assert [tuple(r) for r in g.add(g.select("n", ["d"]), "back").table().collect()] == [("d", "", "")]
    assert g.select("unknown").nodes.count() == 0
    back = g.step(g.select("n", ["a", "b", "c"]), "next")  # nothing new: edges, no nodes
    assert back.edges.count() == 3 and back.nodes.count() == 0


def test_schema_graph(spark):
    c = Catalog()
    c.interface("Named", [Field("name", "string")])
    c.composite("Person", [Field("boss", "Person")], ("Named",))
    c.enum("Color", ["red"])
    g = schema_graph(spark, c)
    got = g.add(g.select("composites"), "interfaces").table().collect()
    assert [tuple(r) for r in got] == [("Person", "interfaces", "Named")]
    types = g.project(g.step(g.select("composites"), "fields"), "type").sorted("target").collect()
    assert [(r["source"], r["target"]) for r in types] == [("Person", "Person"), ("Person", "string")]
    assert {r["target"] for r in g.either(g.select("types"), ["variants", "owner"]).edges.collect()} == {"Color.red"}


def test_stream_windows(spark, tmp_path):
    from larkspur.streaming.windows import tumbling

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = tumbling(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == source.count()
