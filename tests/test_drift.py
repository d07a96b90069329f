import itertools
import random

from braidwork.operators.drift import Node, assign, edit_script, preceding_files, schema_changes, unified_feed

FILES = "file_id bigint, feed string, channel_id bigint, file_seq int, delim string"
LINES = "line_id bigint, file_id bigint, line_no int, raw_text string"


def test_assignment_is_cheapest():
    rnd = random.Random(3)
    for _ in range(40):
        n = rnd.randint(1, 6)
        cost = [[rnd.randint(0, 9) for _ in range(n)] for _ in range(n)]
        least = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert sum(cost[i][j] for i, j in enumerate(assign(cost))) == least


def test_nested_script():
    old = (Node("id", "id"), Node("price", "price", children=(Node("amount", "amount", "decimal"), Node("unit", "unit"))))
    new = (Node("price", "price", children=(Node("amount", "amount", "text"),)), Node("id", "id"), Node("tag", "tag"))
    cost, script = edit_script(old, new)
    changes = [s for s in script if s[0] != "kept"]
    assert sorted(changes) == [("added", "", "tag"), ("removed", "price.unit", ""), ("retyped", "price.amount", "price.amount")]
    assert cost == 2


def test_moves_and_nested_headers(spark):
    facts = lambda h: {"hashes": [h] * 16, "n": 9, "n_at": 0, "chars": 40}
    leaf = lambda name, h: Node(name, name, "text", facts(h))
    old = (leaf("id", 1), Node("home", "home", children=(leaf("town", 2), leaf("street", 3))), Node("work", "work", children=(leaf("firm", 4),)))
    new = (leaf("id", 1), Node("home", "home", children=(leaf("street", 3),)), Node("work", "work", children=(leaf("firm", 4), leaf("town", 2))))
    cost, script = edit_script(old, new)
    assert [s for s in script if s[0] != "kept"] == [("moved", "home.town", "work.town")] and cost == 0
    got = feed(spark, ["id,home.town,work.firm", "1,Ulm,Ox"] + [f"{i},Town{i},Firm{i}" for i in range(9)], ["id,work.firm,work.town", "1,Ox,Ulm"] + [f"{i},Firm{i},Town{i}" for i in range(9)])
    changes = {(r["file_id"], r["change_kind"], r["field_name"]) for r in schema_changes(*got).collect()}
    assert changes == {(2, "renamed", "work.town")}


def test_names_side_by_side_are_never_one_field():
    same = {"hashes": [5] * 16, "n": 9, "n_at": 0, "chars": 40}
    a, b = Node("mobile", "mobile", "text", same), Node("landline", "landline", "text", same)
    assert [s[0] for s in edit_script((a,), (b,))[1]] == ["renamed", "kept"]
    assert sorted(s[0] for s in edit_script((a,), (b,), apart=frozenset({("mobile", "landline")}))[1]) == ["added", "removed"]


def feed(spark, *contents, delim=","):
    files, lines, n = [], [], 0
    for i, rows in enumerate(contents, 1):
        files.append((i, "customers_v1", 1, i, delim))
        for k, t in enumerate(rows, 1):
            n += 1
            lines.append((n, i, k, t))
    return spark.createDataFrame(files, FILES), spark.createDataFrame(lines, LINES)


def test_changes_and_unified_rows(spark):
    a = ["Customer_ID,Full_Name,Registration_Date,Account_Status", "CUST1,Ann Lee,2024-01-02,Active", "CUST2,Bo Ray,2024-02-03,Pending", 'CUST3,"Bad,2024-02-03,Active']
    b = ['full_name, "CUSTOMER_ID" ,Registration_Date,Account_Status,Country', "Ann Lee,CUST1,2024-01-02,Active,DE", "Bo Ray,CUST2,2024-02-03,,FR"]
    c = ["full_name,kunden_nr,reg_dt,Country", "Ann Lee,1,1704153600,DE", "Bo Ray,2,1706918400,FR"]
    files, lines = feed(spark, a, b, c)
    got = sorted((r["file_id"], r["change_kind"], r["field_name"]) for r in schema_changes(files, lines).collect())
    assert got == [(2, "added", "Country"), (3, "removed", "Account_Status"), (3, "renamed", "kunden_nr"), (3, "renamed", "reg_dt"), (3, "retyped", "kunden_nr"), (3, "retyped", "reg_dt")]
    rows = {r["line_id"]: (r["customer_number"], r["customer_name"], r["registered"], r["country"]) for r in unified_feed(files, lines).collect()}
    assert rows == {2: ("CUST1", "Ann Lee", "2024-01-02", None), 3: ("CUST2", "Bo Ray", "2024-02-03", None), 6: ("CUST1", "Ann Lee", "2024-01-02", "DE"), 7: ("CUST2", "Bo Ray", "2024-02-03", "FR"), 9: ("1", "Ann Lee", "1704153600", "DE"), 10: ("2", "Bo Ray", "1706918400", "FR")}


def test_mere_rewriting_is_no_change(spark):
    files, lines = feed(spark, ["Customer_ID,Full_Name", "1,Ann"], ['"customer_id", FULL_NAME ', "2,Bo"], ["Full_Name,Customer_ID", "Cy,3"])
    assert schema_changes(files, lines).count() == 0


def test_unknown_names_by_content(spark):
    mails = [f"p{i}@x.example" for i in range(9)]
    files, lines = feed(spark, ["Customer_ID,Full_Name,Email_Address", *[f"{i},Ann,{m}" for i, m in enumerate(mails)]], ["Customer_ID,Full_Name,Postbox", *[f"{i},Ann,{m}" for i, m in enumerate(mails)]])
    assert [tuple(r) for r in schema_changes(files, lines).collect()] == [(2, "renamed", "Postbox")]


def test_gaps_nulls_and_empty(spark):
    f = spark.createDataFrame([(1, 1, 1), (2, 1, 4), (3, 1, 5), (4, 2, 2), (5, None, 3), (6, 2, None), (7, 2, 3), (8, 2, 3)], "file_id bigint, channel_id bigint, file_seq int")
    assert sorted(tuple(r) for r in preceding_files(f).collect()) == [(2, 1), (3, 2), (7, 4)]
    e = spark.createDataFrame([], FILES + ", change_kind string"), spark.createDataFrame([], LINES)
    assert schema_changes(*e).count() == 0


def test_file_without_lines_or_header(spark):
    files, lines = feed(spark, ["Customer_ID,Full_Name", "1,Ann"], ["Customer_ID,Full_Name,Phone"], [])
    assert [tuple(r) for r in schema_changes(files, lines).collect()] == [(2, "added", "Phone")]
