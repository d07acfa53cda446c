from pyspark.sql import functions as F

from turnledger.operators.engines import end_tokens, ends_with_end_token, generation_mode_error, gradient_errors, is_loopback, returned_outputs, stop_reason, zipped
from turnledger.operators.manifests import file_differences, same_keys, summed_maps


def test_outputs(spark):
    df = spark.createDataFrame([([1, 2], [1, 2, 3, 9], [9], 5), ([1], [2], None, 1), ([], [4, 5], [9], 2), ([1], [1], [9], 3)], "p array<int>, r array<int>, e array<int>, n int")
    out = returned_outputs(F.col("p"), F.col("r"))
    got = df.select(out.alias("o"), ends_with_end_token(out, F.col("e")).alias("x"), stop_reason(out, F.col("e"), F.col("n")).alias("s")).collect()
    assert [tuple(r) for r in got] == [([3, 9], True, "eos"), (None, None, "other"), ([4, 5], False, "length"), ([], False, "other")]
    ends = spark.createDataFrame([(1, None), (None, [2]), (None, None)], "a int, b array<int>").select(end_tokens(F.col("a"), F.col("b")).alias("e")).collect()
    assert [r["e"] for r in ends] == [[1], [2], None]


def test_settings(spark):
    urls = {"http://127.0.0.1:80": True, "http://localhost/": True, "http://[::1]:9": True, "https://localhost": False, "http://example.org": False, "http://127.0.0.1@evil": False, "http://localhost:99999": False, "http://localhost/x": False, None: False}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", is_loopback(F.col("u")).alias("x")).collect()
    assert {r["u"]: r["x"] for r in got} == urls
    base = '"max_new_tokens":5,"eos_token_id":1,"pad_token_id":0'
    settings = {f"{{{base}}}": None, f'{{{base},"num_beams":2}}': "beams", f'{{{base},"stop_strings":["x"]}}': "rewriting_decoder", '{"eos_token_id":1}': "no_limit", f'{{{base},"forced_eos_token_id":3}}': "forced_tokens", f'{{{base},"is_encoder_decoder":true}}': "encoder_decoder"}
    got = spark.createDataFrame([(s,) for s in settings], "s string").select("s", generation_mode_error(F.parse_json("s")).alias("e")).collect()
    assert {r["s"]: r["e"] for r in got} == settings


def test_gradients_and_zips(spark):
    g = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 0.0), ("b", 0.0), ("c", -1.0), ("c", 1.0), ("d", float("nan")), ("d", 1.0), ("e", 1.0), ("f", None), ("f", 1.0)], "run string, v double")
    assert {r["run"]: r["error"] for r in gradient_errors(g, run=["run"], value="v", expected=2).collect()} == {"a": None, "b": "all_zero", "c": "negative", "d": "not_finite", "e": "count", "f": "not_finite"}
    a = spark.createDataFrame([("s", 1, [1]), ("s", 5, [2]), ("t", 1, [3]), (None, 1, [4])], "s string, n int, ids array<int>")
    b = spark.createDataFrame([("s", 2, [1]), ("s", 9, [7]), ("s", 11, [8]), (None, 3, [4]), ("u", 0, [0])], "s string, n int, ids array<int>")
    got = {(r["s"], r["position"]): r["error"] for r in zipped(a, b, scope=["s"], order="n", fields=["ids"]).collect()}
    assert got == {("s", 0): None, ("s", 1): "ids", ("s", 2): "missing_left", ("t", 0): "missing_right", (None, 0): None, ("u", 0): "missing_left"}


def test_manifests(spark):
    listed = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z"), ("d", 4, "w"), ("d", 4, "w")], "name string, bytes int, sha256 string")
    found = spark.createDataFrame([("a", 1, "x"), ("b", 2, "changed"), ("d", 4, "w"), ("e", 5, None)], "name string, bytes int, sha256 string")
    assert {r["name"]: r["problem"] for r in file_differences(listed, found).collect()} == {"b": "sha256", "c": "missing", "d": "repeated", "e": "unexpected"}
    m = spark.createDataFrame([("r", {"a": 1, "b": 2}), ("r", {"a": 3}), ("q", None)], "run string, m map<string,int>")
    assert [r["closed"] for r in same_keys(m, column="m", expected=["b", "a"]).collect()] == [True, False, False]
    assert {(r["run"], r["name"]): r["total"] for r in summed_maps(m, by=["run"], column="m").collect()} == {("r", "a"): 4, ("r", "b"): 2}


def test_runs_and_their_arguments(spark):
    from turnledger.operators.manifests import argument_error, run_error

    good = ([0, 0], False, {"a": "1", "b": "2"}, {"b": "2", "a": "1"}, "end", 4, None, "cpu", True)
    change = lambda i, v: tuple(v if k == i else x for k, x in enumerate(good))
    rows = [good, change(0, [0, 1]), change(0, []), change(0, None), change(0, [None]), change(1, True), change(1, None), change(2, {"a": "1"}), change(2, None), change(4, ""), change(4, None)]
    rows += [change(5, 0), change(5, None), change(6, 5), change(6, 4), change(7, "tpu"), change(7, "cuda:1"), change(8, None)]
    schema = "exit_codes array<int>, oom boolean, config map<string,string>, expected map<string,string>, marker string, steps int, stop_after int, device string, same boolean"
    df = spark.createDataFrame(rows, schema).select(run_error().alias("run"), argument_error(F.col("steps"), F.col("stop_after"), F.col("device"), F.col("same")).alias("arguments"))
    got = [tuple(r) for r in df.collect()]
    assert [r for r, _ in got] == [None] + ["exit_code"] * 4 + ["out_of_memory"] * 2 + ["config"] * 2 + ["marker"] * 2 + [None] * 7
    assert [a for _, a in got] == [None] * 11 + ["steps"] * 2 + ["stop_after", None, "device", None, "tokenizer"]
