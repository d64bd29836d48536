"""Pool lists, attribution, acceleration files and month arithmetic."""

import datetime as dt
import json

import pytest

from feefloor.operators import accelerations as acc
from feefloor.operators import attribution as att
from feefloor.plans import jobs
from feefloor.sources import accelerations as src
from feefloor.sources import pools as sp
from feefloor.sources.chain import month_window

# Own cases: a pool by address only, one by several tags, one with neither id.
ROWS = [{"name": "Juniper", "id": 3, "tags": ["jnp", "/juniper/"], "addresses": []},
        {"name": "Hazel & Sons", "id": 20, "tags": [], "addresses": ["addr-h1", "addr-h2"]},
        {"name": "Willow", "tags": ["wil"], "addresses": ["addr-w"]}]
PARSED = {"Juniper": (3, ["jnp", "/juniper/"], []),
          "Hazel & Sons": (20, [], ["addr-h1", "addr-h2"]), "Willow": (None, ["wil"], ["addr-w"])}


def parse(spark, payload):
    docs = spark.createDataFrame([(json.dumps(payload),)], "value string")
    return {r["pool_name"]: (r["pool_id"], r["tags"], r["addresses"])
            for r in sp.parse_pools(docs).collect()}


def by_name(rows):
    """The other public layout: an object from name to the rest, without ids."""
    return {r["name"]: {k: r[k] for k in ("tags", "addresses")} for r in rows}


@pytest.mark.parametrize("payload,want", [
    (ROWS, PARSED),
    (by_name(ROWS), {name: (None, *rest) for name, (_id, *rest) in PARSED.items()}),
    # entries that are no pools stand between real ones
    ([3.5, ROWS[0], "text", {"tags": ["q"]}, ROWS[1], [[]], None, ROWS[2], {}], PARSED),
    # neither tag nor address: nothing could be attributed to it
    ([ROWS[2], {"name": "Hollow", "id": 4}], {"Willow": PARSED["Willow"]}),
    # ids are whole numbers; anything else is no id
    ([{"name": "S", "id": False, "tags": ["s"]}, {"name": "U", "id": "12", "tags": ["u"]}],
     {"S": (None, ["s"], []), "U": (None, ["u"], [])}),
    # tags and addresses are texts with content
    ([{"name": "M", "id": 2, "tags": [None, "m1", "", 8, "m2"], "addresses": [1, "am"]}],
     {"M": (2, ["m1", "m2"], ["am"])}),
    ([{"name": 12, "tags": ["t"]}, {"name": None, "tags": ["t"]}], {}),
    # said twice, the later entry stands
    ([{"name": "D", "id": 1, "tags": ["d1"]}, {"name": "D", "id": 2, "tags": ["d2"]}],
     {"D": (2, ["d2"], [])}),
    # an object's entry may name itself
    ({"k1": {"name": "Inner", "tags": ["i"]}, "k2": 0}, {"Inner": (None, ["i"], [])}),
    (17, {}),
])
def test_payload_shapes(spark, payload, want):
    assert parse(spark, payload) == want


def test_broken_text_yields_nothing(spark):
    docs = spark.createDataFrame([("{oops",), (None,)], "value string")
    assert sp.parse_pools(docs).isEmpty()


def test_ids_need_no_tag(spark):
    docs = spark.createDataFrame([(json.dumps(
        [{"id": 20, "name": "Hazel"}, *ROWS, {"name": "Plain", "id": 0}]),)], "value string")
    got = {r["pool_id"]: r["pool_name"] for r in sp.parse_pool_ids(docs).collect()}
    assert got == {3: "Juniper", 20: "Hazel & Sons", 0: "Plain"}


POOLS = [("B", 2, ["Tag/", "x"], ["addr1", "shared"]), ("A", 1, ["tag/"], ["shared", "a b", ""]),
         ("C", None, ["tag/long", "$[("], ["addr2"])]
POOL_SCHEMA = "pool_name string, pool_id long, tags array<string>, addresses array<string>"


def test_lookups(spark):
    pools = spark.createDataFrame(POOLS, POOL_SCHEMA)
    assert {r["tag"]: r["pool_name"] for r in att.tag_lookup(pools).collect()} == {
        "tag/": "A", "x": "B", "tag/long": "C", "$[(": "C"}
    assert {r["address"]: r["pool_name"] for r in att.address_lookup(pools).collect()} == {
        "addr1": "B", "addr2": "C"}
    assert {r["pool_id"]: r["pool_name"] for r in att.pool_id_lookup(pools).collect()} == {
        1: "A", 2: "B"}


def test_attribution(spark):
    texts = {1: "by TAG/LONGer", 2: "by TAG/", 3: "nothing", 4: None, 5: "a $[( b", 6: "zXz",
             7: "nothing", 8: ""}
    stamp = dt.datetime(2024, 3, 5, 23, 59)
    headers = spark.createDataFrame(
        [(n, f"h{n}", stamp, 1, 2, 3, None if s is None else s.encode().hex())
         for n, s in texts.items()]
        + [(9, "h9", stamp, 1, 2, 3, "41ff42" + "tag/".encode().hex())],
        "number long, hash string, timestamp timestamp, weight long, size long, "
        "transaction_count long, coinbase_param string")
    base = spark.createDataFrame(
        [("c1", 1, True, ["addr1"]), ("c3", 3, True, ["addr2", "addr1"]),
         ("c7", 7, True, ["shared"]), ("t8", 8, False, ["addr1"])],
        "tx_hash string, block_number long, is_coinbase boolean, coinbase_addresses array<string>")
    got = {r["block_number"]: (r["pool_name"], r["pool_source"]) for r in att.attribute_pools(
        headers, base, spark.createDataFrame(POOLS, POOL_SCHEMA)).collect()}
    unknown = ("Unknown", "unattributed")
    assert got == {1: ("C", "coinbase_tag"), 2: ("A", "coinbase_tag"),
                   3: ("B", "payout_address"), 4: unknown, 5: ("C", "coinbase_tag"),
                   6: ("B", "coinbase_tag"), 7: unknown, 8: unknown, 9: ("A", "coinbase_tag")}
    text = {r["block_number"]: r["coinbase_text"] for r in att.block_rows(headers).collect()}
    assert text[9] == "A�Btag/" and text[4] == ""


def payment(status, pool, fee, **more):
    return {"status": status, "minedByPoolUniqueId": pool, "feeDelta": fee, **more}


@pytest.fixture
def monthly_files(tmp_path):
    """Three months with payments, one with an empty list, one file without a byte."""
    files = {
        "2025-06": [payment("completed", 20, 4_000, txid="t1"),
                    payment("completed", 3, 700), payment("completed", 20, 1),
                    payment("mined", 3, 10**6)],
        "2025-07": [payment("completed", 81, 60), payment("completed_provisional", 20, 5),
                    payment("failed_provisional", 20, 30), payment(None, 3, 2)],
        "2025-08": [],
        "2025-09": [payment("completed", 3, 0), payment("completed", 20, None),
                    payment("completed", None, 12)]}
    folder = tmp_path / "acc"
    folder.mkdir()
    for month, records in files.items():
        (folder / f"{month}.json").write_text(json.dumps(records, indent=len(records)))
    (folder / "2025-05.json").touch()
    (tmp_path / "pools.json").write_text(json.dumps(ROWS))
    return tmp_path


def test_monthly_fees(spark, monthly_files):
    nested = jobs.run_accelerations(spark, str(monthly_files / "acc"),
                                    str(monthly_files / "pools.json"), str(monthly_files / "out"))
    got = {r["month"]: ([(p["pool_name"], p["fee"]) for p in r["pools"]], r["sum"])
           for r in nested.collect()}
    assert got["2025-05"] == got["2025-08"] == ([], 0)
    assert got["2025-06"] == ([("Hazel & Sons", 4_001), ("Juniper", 700)], 4_701)
    assert got["2025-07"] == ([("Hazel & Sons", 5)], 5)
    assert sorted(got["2025-09"][0]) == [("Hazel & Sons", 0), ("Juniper", 0)]
    written = spark.read.json(str(monthly_files / "out/accelerations_by_month.json")).collect()
    values = {r["month"]: json.loads(r["value"]) for r in written}
    assert values["2025-06"] == {"pools": {"Hazel & Sons": 4_001, "Juniper": 700}, "sum": 4_701}


@pytest.mark.parametrize("multi_line,text", [
    (True, '[{"status": "completed", "feeDelta": 3}, {"status": "comp'),
    (False, '{"status": "completed", "feeDelta": 3}\n{"status": "comp')])
def test_a_cut_file_stops_the_read(spark, monthly_files, multi_line, text):
    folder = monthly_files / "more"
    folder.mkdir()
    (folder / "2025-10.json").write_text(text)
    with pytest.raises(Exception, match="2025-10.json"):
        src.read_accelerations(spark, str(folder), multi_line).select("feeDelta").collect()


def test_json_lines(spark, tmp_path):
    (tmp_path / "2025-11.json").write_text("\n".join(
        json.dumps(payment("completed", 3, n)) for n in (8, 9)))
    got = src.read_accelerations(spark, str(tmp_path), multi_line=False).collect()
    assert sorted((r["month"], r["feeDelta"]) for r in got) == [("2025-11", 8), ("2025-11", 9)]


def test_repeated_txids_all_count(spark):
    records = spark.createDataFrame(
        [("2024-01", "completed", 1, 5), ("2024-01", "completed", 1, 5),
         ("2024-01", None, 1, 5)],
        "month string, status string, minedByPoolUniqueId long, feeDelta long")
    ids = spark.createDataFrame([(1, "A")], "pool_id long, pool_name string")
    got = acc.pool_fees_by_month(records, ids, records).collect()
    assert [(r["pool_name"], r["fee_sats"], r["month_sum"]) for r in got] == [("A", 10, 10)]


@pytest.mark.parametrize("loaded,as_of,want", [
    (["2023-12"], dt.date(2024, 3, 15), ["2024-01", "2024-02"]),
    (["2024-01", "2024-10", "notes"], dt.date(2025, 1, 1), ["2024-11", "2024-12"]),
    (["2026-08"], dt.date(2026, 9, 7), []),
    (["2026-09"], dt.date(2026, 9, 7), []),
])
def test_months_to_load(spark, loaded, as_of, want):
    df = spark.createDataFrame([(m,) for m in loaded], "month string")
    assert [r["month"] for r in src.months_to_load(df, as_of).collect()] == want


def test_no_loaded_month_is_an_error(spark):
    df = spark.createDataFrame([("notes",)], "month string")
    with pytest.raises(Exception, match="no monthly files"):
        src.months_to_load(df, dt.date(2024, 1, 1)).collect()


def test_month_window():
    assert month_window("2023-12") == month_window("2023-12")
    w = month_window("2023-12")
    assert (w.start, w.end) == (dt.date(2023, 12, 1), dt.date(2024, 1, 1))


def test_refresh_pools(spark, tmp_path):
    listing, table = tmp_path / "list.json", str(tmp_path / "pools")

    def refreshed(rows, **options):
        listing.write_text(json.dumps(rows))
        diff = jobs.refresh_pools(spark, str(listing), table, **options)
        return {(r["pool_name"], r["change"]) for r in diff.collect()}

    assert refreshed(ROWS[:2]) == {("Juniper", "new"), ("Hazel & Sons", "new")}
    change = {("Juniper", "not upstream"), ("Willow", "new"), ("Hazel & Sons", "same")}
    assert refreshed(ROWS[1:], print_only=True) == change
    assert {r["pool_name"] for r in spark.read.parquet(table).collect()} == {
        "Juniper", "Hazel & Sons"}
    assert refreshed(ROWS[1:]) == change
    with pytest.raises(ValueError, match="no usable pool"):
        refreshed([{"name": "Hollow"}])
    assert {r["pool_name"] for r in spark.read.parquet(table).collect()} == {
        "Hazel & Sons", "Willow"}


def test_a_folder_without_a_table_is_no_empty_table(spark, tmp_path):
    listing, table = tmp_path / "list.json", tmp_path / "pools"
    listing.write_text(json.dumps(ROWS))
    table.mkdir()
    (table / "_SUCCESS").touch()
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA"):
        jobs.refresh_pools(spark, str(listing), str(table))


def test_what_becomes_of_each_pool(spark):
    schema = "pool_name string, pool_id long, tags array<string>, addresses array<string>"
    old = spark.createDataFrame([
        ("same", 1, ["x", "y"], ["a"]), ("tag", 2, ["x"], ["a"]), ("moved", None, [], ["a", "b"]),
        ("both", 4, ["x"], []), ("gone", 5, ["x"], [])], schema)
    new = spark.createDataFrame([
        ("same", 1, ["y", "x", "x"], ["a"]), ("tag", 2, ["x", "z"], ["a"]),
        ("moved", None, [], ["a", "c"]), ("both", 4, ["y"], ["n"]), ("born", 7, ["q"], [])], schema)
    diff = att.pool_list_diff(old, new)
    assert {r["pool_name"]: r["change"] for r in diff.collect()} == {
        "same": "same", "tag": "tags", "moved": "addresses", "both": "tags and addresses",
        "gone": "not upstream", "born": "new"}
    counts = att.pool_list_counts(diff).first().asDict()
    assert counts == {"upstream": 5, "in_use": 5, "with_id": 4, "new": 1, "not_upstream": 1,
                      "tags_changed": 2, "addresses_changed": 2}


def test_tags_of_every_length(spark):
    """Shorter than a piece, as long, and longer; at the start, the end and twice."""
    texts = ["", "a", "xab", "/abcd/", "abcde fgh abcde", "abcdX", "ABCDE", "日本語テスト", None, "%_"]
    tags = ["a", "ab", "abcd", "abcde", "bcde f", "日本", "語テスト", "%", "_", "zz"]
    blocks = spark.createDataFrame(list(enumerate(texts)), "block_number long, coinbase_text string")
    pools = spark.createDataFrame([("P", t) for t in tags] + [("Q", "")],
                                  "pool_name string, tag string")
    found = att.tag_matches(blocks, pools)
    got = [(r["block_number"], r["tag"]) for r in found.collect()]
    assert sorted(got) == sorted((i, t) for i, x in enumerate(texts) for t in tags
                                 if t in (x or "").lower())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
