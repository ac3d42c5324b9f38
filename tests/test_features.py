"""Row features, encoders, graph, rules."""

from __future__ import annotations

import random

import pytest

from chronolith.functions import rows
from chronolith.operators import encoders, graph, rules, tables
from chronolith.operators.components import ancestors, connected_components
from chronolith.plans.features import FeaturePlan, configure
from chronolith.spec import Roles

ROLES = Roles()


def column(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_time(spark):
    df = spark.createDataFrame([(1, 3600), (2, 43200), (3, 75600), (4, None)], "id long, t long")
    out = rows.time_features(df)
    assert column(out, "t_hour") == [1, 12, 21, 0] and column(out, "is_midnight_flag") == [1, 0, 0, 0] and column(out, "time_of_day") == [0, 2, 3, 0] and column(out, "t_dow")[0] == 3


def test_email(spark):
    df = spark.createDataFrame([(1, "Gmail.com"), (2, "Mailinator.com"), (3, None), (4, " Yahoo.co.uk"), (5, "corp.example")], "id long, e string")
    out = rows.email_features(df, "e")
    assert column(out, "e_missing_flag") == [0, 0, 1, 0, 0] and column(out, "e_is_disposable") == [0, 1, 0, 0, 0] and column(out, "e_is_trusted") == [1, 0, 0, 1, 0]
    assert column(out, "e_is_unknown") == [0, 0, 0, 0, 1] and column(out, "e_domain") == ["gmail.com", "mailinator.com", "unknown", "yahoo.co.uk", "corp.example"]


def test_card_address_cross(spark):
    df = spark.createDataFrame([(1, 1.0, 100.0, None), (2, None, None, 200.0), (3, 3.0, 300.0, 300.0)], "id long, card2 double, addr1 double, addr2 double")
    out = rows.cross_features(rows.address_features(rows.card_features(df)), [("card2", "addr1"), ("card2", "absent")])
    assert column(out, "card2_missing_flag") == [0, 1, 0] and column(out, "card3_missing_flag") == [1, 1, 1]
    assert column(out, "addr1_addr2") == ["100.0@NA", "NA@200.0", "300.0@300.0"] and column(out, "card2@addr1") == ["1@100", "NA@NA", "3@300"] and "card2@absent" not in out.columns


def test_device(spark):
    os_ = ["Android 7.0", "iOS 11.1.2", "Windows 10", "Mac OS X 10_11_6", None, "—", "Linux"]
    info = [None, None, None, None, "iOS Device", "SAMSUNG SM-G892A Build/NRD90M", None]
    kind = ["desktop", "mobile", "desktop", "desktop", "mobile", "mobile", "desktop"]
    df = spark.createDataFrame([(k, os_[k], info[k], kind[k], None) for k in range(7)], "id long, id_30 string, DeviceInfo string, DeviceType string, id_31 string")
    out = rows.device_features(df)
    assert column(out, "device_os_android") == [1, 0, 0, 0, 0, 1, 0] and column(out, "device_os_ios") == [0, 1, 0, 0, 1, 0, 0] and column(out, "device_os_macos") == [0, 0, 0, 1, 0, 0, 0] and column(out, "device_os_unknown")[6] == 1
    assert column(out, "os_android_ver_tier")[0] == "low" and column(out, "os_is_very_old")[0] == 1 and column(out, "dev_os_devicetype_conflict")[0] == 1
    assert column(out, "id30_missing_but_devinfo_ok")[4] == 1 and column(out, "browser_unknown")[4] == 1 and column(out, "devinfo_has_build_tag")[5] == 1


def test_hash_bucket_is_the_md5_number(spark):
    import hashlib

    df = spark.createDataFrame([("abc",), ("",), (None,)], "v string")
    for size in (64, 97):
        got = [r[0] for r in df.select(rows.hash_bucket(df["v"], size)).collect()]
        assert got == [int(hashlib.md5(v.encode()).hexdigest(), 16) % size for v in ("abc", "")] + [-1]


def test_missing_pattern(spark):
    train = spark.createDataFrame([(1, 1.0, None, 1), (2, None, None, 2), (3, 3.0, 6.0, 3)], "id long, id_01 double, id_02 double, V1 int")
    state = encoders.fit_missing_pattern(train, ["id_01", "id_02", "V1"])
    out = encoders.missing_pattern(train, state)
    assert column(out, "total_missing_count") == [1, 2, 0] and column(out, "id_cols_missing_count") == [1, 2, 0]
    gone = encoders.missing_pattern(train.drop("id_02"), state)
    assert column(gone, "id_02_missing_flag") == [0, 0, 0] and "V1_missing_flag" not in gone.columns


@pytest.mark.parametrize("smoothing, least, want", [(0.0, 0, {"A": 0.5, "B": 1.0, "C": 2 / 3, None: 2 / 3}), (0.0, 10, {"A": 2 / 3, "B": 2 / 3, "C": 2 / 3, None: 2 / 3})])
def test_target_encoding(spark, smoothing, least, want):
    train = spark.createDataFrame([("A", 1), ("A", 0), ("B", 1), ("B", None)], "c string, y int")
    state = encoders.fit_target_encoding(train, "c", "y", smoothing, least)
    val = spark.createDataFrame([(k, c, 99) for k, c in enumerate(want)], "id long, c string, y int")
    assert column(encoders.target_encode(val, state, "c"), "c_te") == pytest.approx(list(want.values()))


def test_label_encoding_and_uid(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    val = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z")], "id long, c string")
    assert column(encoders.label_encode(val, encoders.fit_label_encoding(train, "c"), "c"), "c_label") == [0, 1, 2, -1]
    old = spark.createDataFrame([(1, 1.5, 10, 5.0), (2, 1.5, 20, 7.0)], "id long, key double, t long, amt double")
    new = spark.createDataFrame([(3, 1.5, 30, 6.0), (4, 9.0, 31, 1.0)], "id long, key double, t long, amt double")
    out = encoders.uid_features(new, encoders.fit_uid(old, ROLES, ["key"]), ROLES, ["key"], [5])
    assert column(out, "uid") == ["2", "9"] and column(out, "uid_is_new") == [0, 1] and column(out, "uid_txn_count") == [2, 0] and column(out, "uid_time_since_last") == [10, 1]


def test_graph(spark):
    rows_ = [(1, "A", 1, "1", "gmail", 0), (2, "A", 2, "1", "gmail", 1), (3, "B", 3, "2", "yahoo", 0), (4, "B", 4, "2", "yahoo", 1), (5, "A", 5, "1", "hotmail", 0)]
    df = spark.createDataFrame(rows_, "id long, key string, t long, addr string, mail string, y int")
    out = graph.entity_history(df, ROLES, ["key", "addr"])
    assert column(out, "key_fraud_count") == [0, 0, 0, 0, 1] and column(out, "addr_fraud_count")[2] == 0
    seen = graph.distinct_before(df, ROLES, {"addr": ["addr"], "mail": ["mail"]})
    assert column(seen, "key_unique_addr") == [0, 1, 0, 1, 1] and column(seen, "key_unique_mail") == [0, 1, 0, 1, 1]


def test_component_size(spark):
    df = spark.createDataFrame([(1, "A", 1, "1"), (2, "A", 2, "2"), (3, "B", 3, "2"), (4, "C", 4, "3"), (5, "C", 5, "3"), (6, None, 6, "3")], "id long, key string, t long, addr string")
    assert column(graph.component_size(df, ROLES, ["addr"]), "component_size") == [1, 2, 1, 1, 2, 0]


def test_component_size_broadcasts_nothing_that_grows_with_the_rows(spark, capsys):
    df = spark.range(40).selectExpr("id", "concat('K', id % 9) as key", "id as t", "concat('a', id % 4) as addr")
    graph.component_size(df, ROLES, ["addr"]).explain()
    tree = spark.createDataFrame([(k, k - 1, k) for k in range(1, 9)], "node long, parent long, at long")
    ancestors(tree)[1].explain()
    plans = capsys.readouterr().out
    assert plans.count("SortMergeJoin") == 2 and "Broadcast" not in plans


def test_component_size_of_a_giant_component_in_bounded_tasks(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, *[f"K{i}" for i in range(60)]]), rng.randrange(90), rng.choice([None, None, "hub", "a", "b", "c"]), rng.choice([None, *"uvwxyz"])) for k in range(300)]
    parts, want = {}, {}
    for k, key, _, addr, mail in sorted(rows, key=lambda r: (r[2], r[0])):
        own = [n for n in (key and f"key:{key}", addr and f"addr:{addr}", mail and f"mail:{mail}") if n]
        want[k] = len(parts.get(own[0], own[:1])) if key else 0
        whole = set().union(*[parts.get(n, {n}) for n in own]) if own else set()
        parts |= dict.fromkeys(whole, whole)
    assert max(want.values()) > 50
    df = spark.createDataFrame(rows, "id long, key string, t long, addr string, mail string")
    for n in (11, 100, 1000):
        out = graph.component_size(df, ROLES, ["addr", "mail"], segment_rows=n)
        assert {r["id"]: r["component_size"] for r in out.collect()} == want


def test_connected_components_against_union_find(spark):
    import random

    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5200)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*edges, (None, 1)], "src long, dst long")).collect()}
    assert got == {k: root(k) for k in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_rules_in_order(spark):
    df = spark.createDataFrame([(1, "bad", 1, 5.0), (2, "k", 2, 5.0), (3, "k", 3, 5.0), (4, "k", 4, 99999.0), (5, "m", 5, 10000.0), (6, None, 6, 20000.0)], "id long, key string, t long, amt double")
    engine = rules.RuleEngine([rules.Blacklist("key", spark.createDataFrame([("bad",), (None,)], "value string")), rules.Velocity(10, 2), rules.Amount(10000.0)])
    out = {r["id"]: r["rule"] for r in engine.evaluate(df, ROLES).collect()}
    assert out == {1: "blacklist", 2: None, 3: None, 4: "velocity", 5: None, 6: "amount"} and engine.list_rules() == ["blacklist", "velocity", "amount"]


def test_split_folds_align(spark):
    df = spark.range(20).selectExpr("id", "20 - id as t")
    split = tables.time_split(df, ["t", "id"], 0.2)
    assert {r["id"] for r in split.where("is_val").collect()} == {0, 1, 2, 3}
    folds = tables.purged_folds(df, ["t", "id"], 3, 2)
    assert folds.where("fold = 1 and not is_val").count() == 5 and folds.where("fold = 1 and is_val").count() == 3
    assert tables.align(df, ["t", "x"]).columns == ["t", "x"]
    with pytest.raises(ValueError):
        tables.require(df, ["nope"])


def test_feature_plan_fits_on_training_rows_only(spark, tmp_path):
    train = spark.createDataFrame([(1, "A", 3600, 10.0, 1), (2, "A", 43200, 20.0, 0), (3, "B", 75600, 30.0, 1)], "id long, key string, t long, amt double, y int")
    val = spark.createDataFrame([(4, "A", 86400, 999.0, 99), (5, "A", 90000, 1000.0, 99)], "id long, key string, t long, amt double, y int")
    plan = FeaturePlan(configure(["time", {"aggregation": {"group_keys": [["key"]], "stats": ["count", "sum"]}}, {"target_encoding": {"column": "key", "smoothing": 0.0, "min_samples": 0}}, "missing_pattern"]), ROLES)
    assert plan.fit_transform(train).count() == 3
    out = plan.transform(val)
    assert column(out, "key_amt_count") == [0, 1] and column(out, "key_amt_sum") == [0, 999] and column(out, "key_te") == [0.5, 0.5]
    plan.save(str(tmp_path / "plan"))
    again = FeaturePlan(plan.steps, ROLES).load(spark, str(tmp_path / "plan")).transform(val)
    assert column(again, "key_te") == [0.5, 0.5]
    assert plan.catalog(spark).where("feature = 'key_te' and stateful and uses_target").count() == 1
    with pytest.raises(ValueError):
        configure(["nothing"])
