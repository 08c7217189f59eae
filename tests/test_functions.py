from pyspark.sql import functions as F

from crosswalk.functions import names, paths, types, values


def one(spark, rows, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]


def test_tokens(spark):
    got = one(spark, [("customerId",), ("amount_due",), ("HTTPServer",), ("orderID",), ("_",), ("a-b  c",)], "n STRING", names.tokens("n"))
    assert [r[0] for r in got] == [["customer", "id"], ["amount", "due"], ["httpserver"], ["order", "id"], [], ["a", "b", "c"]]


def test_name_similarity(spark):
    got = one(spark, [("client_id", "customerId"), ("client_id", "currencyCode"), ("created_at", "placedOn"), ("_", "id"),
                      ("category", "cate"), ("cat", "category")], "a STRING, b STRING", names.name_similarity("a", "b"))
    assert [r[0] for r in got] == [0.9, 0.0, 0.8, 0.0, 0.7, 0.0]


def test_stripping_everything_keeps_the_whole_list(spark):
    rows = [("order", "orderId", ["order"]), ("the_code", "code", ["x"])]
    got = one(spark, rows, "a STRING, b STRING, s ARRAY<STRING>", names.name_similarity("a", "b", "s"))
    assert got[0][0] == 0.0  # order against id: nothing alike once order is stripped on the other side
    assert got[1][0] > 0.5


def test_naming_and_packages(spark):
    got = one(spark, [("getOrderById", "my__Pkg.-name", "foo_Bar>=1", "x; extra == 'y'")], "a STRING, b STRING, c STRING, d STRING",
              names.snake(F.col("a")), names.pascal(F.col("b")), names.package_key(F.col("b")), names.requirement_name(F.col("c")),
              names.requirement_name(F.col("d")))
    assert got == [("get_order_by_id", "MyPkgName", "my-pkg-name", "foo_Bar", None)]


def test_type_compat_resolves_only_the_provider(spark):
    rows = [("ref:S", "enum", "string"), ("ref:S", None, "object"), ("ref:S", "enum", "ref:S"), ("list<string>", None, "list<integer>"),
            ("integer", None, "decimal"), ("date", None, "string"), ("boolean", None, "string")]
    got = one(spark, rows, "p STRING, k STRING, c STRING",
              types.type_compat(types.provider_base(F.col("p"), F.col("k")), types.base_type(F.col("c"))))
    assert [r[0] for r in got] == [1.0, 1.0, 0.2, 1.0, 0.9, 0.9, 0.2]


def test_round_half_even_is_exact(spark):
    numbers = [k / 10000 for k in range(0, 10001)]
    got = one(spark, [(x,) for x in numbers], "x DOUBLE", "x", types.round_half_even(F.col("x")))
    assert all(r == round(x, 3) for x, r in got)


def test_round_half_even_over_the_whole_range(spark):
    import random
    rng = random.Random(5)
    numbers = [0.0005, 0.0015, 2.45, 12.35, -2.5, 1e300, -1e-300, 4503599627370.4965, 8796093022207.9995] + [
        rng.choice([-1, 1]) * rng.randint(0, 2 ** 53) * 2.0 ** rng.randint(-80, 20) for _ in range(3000)] + [
        (k + 0.5) / 1000 for k in range(-3000, 3000)] + [k / 16 for k in range(-4000, 4000)]
    for digits in (1, 3):
        got = one(spark, [(x,) for x in numbers], "x DOUBLE", "x", types.round_half_even(F.col("x"), digits))
        assert [(x, r) for x, r in got if r != round(x, digits)] == []


def test_same_value(spark):
    rows = [("10.50", "10.5", "decimal", True), ("NaN", "NaN", "decimal", False), ("1", "true", "integer", False), (None, None, "string", True),
            ("a", None, "string", False), (None, "a", "string", False), ("2026-09-14T21:15:30", "2026-09-14 21:15:30", "datetime", True),
            ("2026-09-14T21:15:30Z", "2026-09-14T21:15:30", "datetime", False), ("2026-09-14T21:15:30Z", "2026-09-14T22:15:30+01:00", "string", True),
            ("1e40", "1e40", "decimal", True), ("1", "1d", "decimal", False), ("0.1", "0.10000000000000000001", "decimal", False),
            ("123456789012345678901234", "123456789012345678901235", "integer", False), ("1e400", "2e400", "decimal", False),
            ("1e400", "10.0E399", "decimal", True), ("-0.0", "0", "decimal", True), ("-1", "1", "integer", False), (" +012.50 ", "1.25e1", "decimal", True),
            ("1e-5", ".00001", "decimal", True), ("inf", "Infinity", "decimal", True), ("inf", "-inf", "decimal", False),
            ("true", "true", "boolean", True), ("2026-09-14T21:15:30", "junk", "datetime", False)]
    got = one(spark, rows, "e STRING, a STRING, t STRING, w BOOLEAN", "e", "a", "w", values.same_value(F.col("e"), F.col("a"), F.col("t")))
    assert [r for r in got if r[2] != r[3]] == []


def test_first_json_object(spark):
    rows = [('Sure! {"a": 1} hope that helps', '{"a": 1}'), ("[1, 2]", None), ("", None), ('```json\n{"pairs": []}\n```', '{"pairs": []}'),
            ('{"a":1} x }', None), ("{'a':1}", None), ('{"a":1},{"b":2}', None), ('{"a":"it\'s"}', '{"a":"it\'s"}'), (None, None)]
    got = one(spark, rows, "t STRING, w STRING", "w", values.first_json_object(F.col("t")))
    assert all(w == g for w, g in got)


def test_samples_of_the_example(spark):
    want = {"orderId": ("integer", "1713"), "customerId": ("integer", "2055"), "totalAmount": ("decimal", "12.25"),
            "currencyCode": ("string", '"currencyCode-90"'), "createdAt": ("datetime", '"2026-09-14T21:15:30"'),
            "shippingCity": ("string", '"shippingCity-14"')}
    got = one(spark, [(n, t, w) for n, (t, w) in want.items()], "n STRING, t STRING, w STRING", "w",
              values.sample_scalar(F.col("t"), F.col("n"), values.name_seed(F.col("n"))))
    assert all(w == g for w, g in got)


def test_paths(spark):
    got = one(spark, [("https://h.example/a/b/?q=1#t", "/x/{id}/y", "/api/", "/{id}/")], "u STRING, t STRING, p STRING, s STRING",
              paths.request_path(F.col("u")), paths.route_pattern(F.col("t")), paths.join_path(F.col("p"), F.col("s")),
              paths.path_vars(F.col("t")))
    assert got == [("/a/b/", "^/x/[^/]+/y/?$", "/api/{id}", ["id"])]


def test_texts(spark):
    got = one(spark, [("a\nlast  ", "<b>&'\"", "```python\nx = 1\n```")], "e STRING, h STRING, f STRING", values.last_line(F.col("e")),
              values.html_escape(F.col("h")), values.strip_code_fence(F.col("f")), values.last_line(F.lit(None).cast("string")))
    assert got == [("last", "&lt;b&gt;&amp;&#x27;&quot;", "x = 1", "no output")]


def test_numbers_of_every_shape(spark):
    """Equality of numbers against exact fractions; far exponents are told apart."""
    from fractions import Fraction

    from crosswalk.functions.values import number_form, same_value
    shown = ["1", "1.0", "01", "+1.000", "-1", "0", "-0.0", "1e0", "10e-1", "0.1e1", "1E+2", "100", " 100 ", "12345678901234567890", "12345678901234567890.0",
             "12345678901234567891", "0.000000000000000001", "1e-18", "0.0000000000000000001", "1e-19", ".5", "5e-1", "5.", "1" + "0" * 60, "1e60", "x", "", "1e", "nan", "NaN"]
    far = "1e" + "9" * 40
    rows = [(a, b) for a in shown for b in shown]
    df = spark.createDataFrame([*rows, (far, "1"), (far, far), (far, "1e" + "9" * 41), (far, "1e0" + "9" * 40), ("inf", "Infinity"), ("-inf", "inf"), ("inf", "1")], "a string, b string")
    def value(t):
        try:
            return Fraction(t.strip()) if t.strip().lower() != "nan" else None
        except ValueError:
            return Fraction(t.strip() + "0") if t.endswith(".") else None
    got = df.select("a", "b", same_value(F.col("a"), F.col("b"), "decimal").alias("same"), (number_form(F.col("a")) == number_form(F.col("b"))).alias("form")).collect()
    for r in got[:len(rows)]:
        x, y = value(r.a), value(r.b)
        assert r.same == (x is not None and y is not None and x == y), r
        assert r.form is None or r.form == r.same, r
    assert [r.same for r in got[len(rows):]] == [False, True, False, True, True, False, False]
