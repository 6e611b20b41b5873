"""Work that must not grow with more than the input."""

import hashlib

from cuefold.operators import checks as ck
from cuefold.operators import signatures as sg
from cuefold.sources import transport as tr


def test_plan_kinds_are_told_without_walking_the_schema(spark, monkeypatch):
    content = '{"outputs":[7,{"segments":{"a":1}},{"segments":[null,{"source_clips":[3,{"episode_id":"e"}]}]}]}'
    plans = spark.createDataFrame([("p", content), ("n", "null"), ("a", "[1]"), ("o", '{"outputs":1}')], "project string, content string")
    monkeypatch.setattr(ck, "durable", lambda df: df)
    rows = ck._plan_rows(plans)
    assert "schema_of_variant" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {(r.project, r.oi, r.si, r.ci): (r.root_kind, r.outputs_kind, r.out_ok, r.n_segments, r.seg_ok, r.n_clips, r.clip_ok) for r in rows.collect()}
    assert got == {
        ("p", 0, None, None): ("OBJECT", "ARRAY", False, -1, False, -1, False), ("p", 1, None, None): ("OBJECT", "ARRAY", True, -1, False, -1, False),
        ("p", 2, 0, None): ("OBJECT", "ARRAY", True, 2, False, -1, False), ("p", 2, 1, 0): ("OBJECT", "ARRAY", True, 2, True, 2, False),
        ("p", 2, 1, 1): ("OBJECT", "ARRAY", True, 2, True, 2, True), ("n", None, None, None): ("", "", False, -1, False, -1, False),
        ("a", None, None, None): ("", "", False, -1, False, -1, False), ("o", None, None, None): ("OBJECT", "", False, -1, False, -1, False),
    }


def test_children_are_stored_once_on_their_way_to_their_parents(spark, monkeypatch):
    leaves = [(f"l{k}", f"o{k % 12}", k // 12, "x") for k in range(240)]
    inner = [(f"o{k}", "c", k, "y") for k in range(12)] + [("c", None, 0, "z")]
    nodes = spark.createDataFrame(leaves + inner, "id string, parent string, at bigint, own string")
    stored, durable = [], sg.durable

    def counted(df):
        table = durable(df)
        stored.append(table.count())
        return table

    monkeypatch.setattr(sg, "durable", counted)
    assert sg.node_signatures(nodes).count() == 253
    assert sum(stored) <= 253 + 2 * 13


def test_signatures_of_repeated_and_stored_nodes(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    shape = "id string, parent string, at bigint, own string"
    # Of a repeated id each row is found, but its parent never has as many children as it has rows.
    twice = spark.createDataFrame([("a", "p", 0, "x"), ("a", "p", 1, "x"), ("b", "q", 0, "y"), ("p", None, 0, "p"), ("q", None, 0, "q"), (None, "q2", 0, "n")], shape)
    got = sorted((r.id or "", r.signature) for r in sg.node_signatures(twice).collect())
    assert got == sorted([("", sha("n")), ("a", sha("x")), ("a", sha("x")), ("b", sha("y")), ("q", sha(f"q|{sha(sha('y'))}"))])
    # A stored signature may be any text, and stays though its node is gone.
    nodes = spark.createDataFrame([("a", "p", 0, "x"), ("b", "p", 1, "y"), ("p", None, 0, "p")], shape)
    held = spark.createDataFrame([("a", "Kept ü"), ("gone", "g")], "id string, signature string")
    got = {r.id: r.signature for r in sg.node_signatures(nodes, held).collect()}
    assert got == {"a": "Kept ü", "gone": "g", "b": sha("y"), "p": sha(f"p|{sha('Kept ü' + sha('y'))}")}


def test_pieces_of_a_text_stay_in_their_unit(spark, monkeypatch):
    content = '{"c":[{"a":"long enough text","b":["long enough text",{"k":"~x"}],"":"long enough text"},"~long literal","~long literal",null],"s":"^x","e":[]}'
    given = spark.createDataFrame([("p", "E1", content), ("p", "E2", content), ("q", "E1", "{}")], "project string, episode_id string, content string")
    texts, durable = [], tr.durable

    def watched(df):
        texts.append(df._jdf.queryExecution().optimizedPlan().toString().lower())
        return durable(df)

    monkeypatch.setattr(tr, "durable", watched)
    rows, strings, columns = tr.pack(tr.shred(given))
    # Of what is given away only whole units are read anew: no piece is a row.
    assert "posexplode(regexp_extract_all" not in "".join(texts + [rows._jdf.queryExecution().optimizedPlan().toString().lower()])
    back = tr.unpack(rows, strings, columns)
    assert "posexplode" not in back._jdf.queryExecution().optimizedPlan().toString().lower()
    want = {(r.project, r.episode_id): r.content for r in given.selectExpr("project", "episode_id", "to_json(parse_json(content)) AS content").collect()}
    assert {(r.project, r.episode_id): r.content for r in tr.assemble(back).collect()} == want
    assert {r.value for r in strings.collect()} == {'"long enough text"', '"~long literal"'}
    packed = {(r.episode_id, r.category, r.idx): r["values"] for r in rows.where("project = 'p'").collect()}
    assert packed["E1", "c", 1] == ['"~1"'] or packed["E1", "c", 1] == ['"~0"']
    assert packed["E1", "s", 0] == ['"^^x"'] and packed["E1", "e", 0] == []
