import pytest
from pyspark.sql import functions as F

from rampart.operators import engines, envelope
from rampart.sources.lines import explode_payloads
from rampart.sources.zeek import parse_zeek_tsv


def parsed(spark, name, lines, options=None):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, text string")
    return [(r["fields"], r["parse_error"]) for r in engines.parse(df, name, options).orderBy("i").collect()]


def test_kv(spark):
    got = parsed(spark, "kv", ['a=1 b="x y" c= word d="q\\"r" a=2 e="open rest', '  k="tail\\\\" z="" y=a=b ', 'x="a"b=c', 'u="a\\', "no pairs"])
    assert [g[0] for g in got] == [{"a": "2", "b": "x y", "c": "", "d": 'q"r', "e": "open rest"}, {"k": "tail\\", "z": "", "y": "a=b"}, {"x": "a", "b": "c"}, {"u": "a\\"}, {}]
    assert parsed(spark, "kv", ['a:1;;b:"x;y"'], {"pair_separator": ";", "kv_separator": ":"})[0][0] == {"a": "1", "b": "x;y"}
    assert parsed(spark, "kv", ['a="x"'], {"strip_quotes": False})[0][0] == {"a": '"x"'}
    long = "k=" + '"' + "v" * 200_000 + '"'
    assert len(parsed(spark, "kv", [long])[0][0]["k"]) == 200_000
    for n in (19, 20, 21, 25, 3000):  # a closing quote after any number of escaped backslashes
        assert parsed(spark, "kv", ['k="a' + "\\\\" * n + '" b=1'])[0][0] == {"k": "a" + "\\" * n, "b": "1"}


def test_csv(spark):
    got = parsed(spark, "csv", ["1,2,3", '"a,b","c""d",e', "1", "1,,3,4,5", '"open, rest', '"ab"c,d,'], {"columns": ["x", "y", "z"]})
    assert [g[0] for g in got] == [{"x": "1", "y": "2", "z": "3"}, {"x": "a,b", "y": 'c"d', "z": "e"}, {"x": "1", "_truncated": "True"},
                                   {"x": "1", "y": None, "z": "3", "_extra.3": "4", "_extra.4": "5"}, {"x": "open, rest", "_truncated": "True"}, {"x": "abc", "y": "d", "z": None}]
    with pytest.raises(ValueError):
        parsed(spark, "csv", ["1"], {})


def test_json(spark):
    got = parsed(spark, "json", ['{"a":1,"b":{"c":[1,{"d":null}],"e":{}},"t":true,"u.v":"x"}', '[{"a":1}]', "[1]", "x", '{"a":1,"a":2}', '{"n":' * 60 + "1" + "}" * 60])
    assert got[0][0] == {"a": "1", "b.c.0": "1", "b.c.1.d": None, "b.e": "{}", "t": "True", "u.v": "x"}
    assert got[1][0] == {"a": "1"} and got[2] == (None, "not_an_object") and got[3] == (None, "invalid_json") and got[4][0] == {"a": "2"}
    assert got[5][0] == {".".join(["n"] * 60): "1"}
    assert parsed(spark, "json", ['{"a":[1,null,"z",true],"b":{"c":[]}}'], {"array_mode": "join"})[0][0] == {"a": "1,null,z,true", "b.c": "[]"}


def test_dissect_takes_the_first_cut(spark):
    assert parsed(spark, "dissect", ["10.0.0.1 - bob [x] end", "nope"], {"pattern": "%{ip} - %{u} [%{+a}] %{+a}", "append_separator": "+"}) == [({"ip": "10.0.0.1", "u": "bob", "a": "x+end"}, None), (None, "ParseError")]
    assert parsed(spark, "dissect", ["a   b;;;", "a b"], {"pattern": "%{x->} %{y->};"}) == [({"x": "a", "y": "b"}, None), (None, "ParseError")]
    # the first delimiter is final: a later one must not rescue the match
    assert parsed(spark, "dissect", ["a-b:c-d"], {"pattern": "%{x}-%{y}-%{z};"})[0] == (None, "ParseError")
    for bad in ("none", "%{a}%{b}"):
        with pytest.raises(ValueError):
            engines.compile_dissect(bad)


def test_grok_tells_empty_from_absent(spark):
    pattern = {"pattern": 'p %{IP:ip}(?:/%{INT:port})? "%{DATA:acl}"(?: opt=%{DATA:o};)?'}
    got = parsed(spark, "grok", ['x p 1.2.3.4/5 "" y', 'p 1.2.3.4 "a" opt=;', "z"], pattern)
    assert got == [({"ip": "1.2.3.4", "port": "5", "acl": ""}, None), ({"ip": "1.2.3.4", "acl": "a", "o": ""}, None), (None, "grok_no_match")]
    with pytest.raises(ValueError, match="unknown grok"):
        engines.compile_grok("%{NOPE:x}")
    with pytest.raises(ValueError, match="nesting"):
        engines.compile_grok("%{A:x}", {"A": "%{A}"})


def test_cef_and_leef(spark):
    got = parsed(spark, "cef", ["h CEF:0|V\\|x|p|1|100|n|9|src=1 msg=a b\\=c\\\\n\\n cs1=v cs1Label=My Key bare dst=2", "CEF:0|a|b", "CEF:0|a|b|c|d|e|f"])
    assert got[0][0] == {"CEFVersion": "0", "deviceVendor": "V|x", "deviceProduct": "p", "deviceVersion": "1", "deviceEventClassId": "100", "name": "n", "severity": "9", "src": "1",
                         "msg": "a b=c\\n\n", "cs1": "v", "cs1Label": "My Key bare", "My Key bare": "v", "dst": "2"}
    assert got[1] == (None, "ParseError") and got[2][0]["severity"] == "f"
    leef = parsed(spark, "leef", ["LEEF:1.0|L|S|1|41|src=1\tcat=a=b\tx", "LEEF:2.0|L|S|1|41|^|src=1^dst=2", "LEEF:2.0|L|S|1|41|0x7C|a=1|b=2", "LEEF:2.0|L|S|1|41||a=1\tb=2", "LEEF:3|x", "LEEF:2.0|L|S|1|41|toolong|a=1"])
    assert [(g[0] or {}).get("src") for g in leef[:2]] == ["1", "1"] and leef[0][0]["cat"] == "a=b" and leef[2][0]["b"] == "2" and leef[3][0]["b"] == "2"
    assert leef[4][0] is None and leef[5][0] is None


def test_zeek_files_with_changing_headers(spark):
    lines = ["#separator \\x09", "#set_separator\t|", "#unset_field\tNA", "#fields\ta\tb", "#types\tstring\tset[string]", "x\tp|NA", "NA\t(empty)\textra", "#fields\tb\ta", "#types\tstring\tstring", "1\t2"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)] + [("g", 0, "1\t2")], "f string, n int, line string")
    rows = {(r["f"], r["n"]): (r["fields"], r["parse_error"]) for r in parse_zeek_tsv(df, ["f"], ["n"]).collect()}
    assert rows[("f", 5)][0] == {"a": "x", "b": '["p",null]'} or rows[("f", 5)][0] == {"a": "x", "b": '["p"]'}
    assert rows[("f", 6)][0] == {"a": None, "b": "[]", "_extra.2": "extra"} and rows[("f", 9)][0] == {"b": "1", "a": "2"}
    assert rows[("g", 0)] == (None, "no #fields header seen") and len(rows) == 4


def test_syslog_envelopes_keep_the_whole_line(spark):
    lines = ["<189>date=1 x=2 y=3", "<14>1 2026-09-01T12:00:03Z fw - - - - 1,2", '<165>1 2003-10-11T22:14:15.003Z m evn - ID47 [ex@1 iut="3" es="A\\"p]"][b@2] msg here', "<4>Sep  2 10:15:32 gw kernel: act=drop",
             "<34>Oct 11 22:14:15 host su[230]: failed", "plain", "<13>Oct 11 22:14:15 h CEF:0|a|b|c|d|e|f|x=1"]
    df = envelope.sniff_layered(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, text string"))
    rows = df.orderBy("i").collect()
    for r in rows:
        assert (r["envelope"] or {"header_raw": ""})["header_raw"] + r["message"] == r["text"]
    assert [(r["outer_format"], r["inner_format"]) for r in rows] == [("syslog", "kv"), ("syslog", "unknown"), ("syslog", "unknown"), ("syslog", "unknown"), ("syslog", "unknown"), ("unknown", "unknown"), ("syslog", "cef")]
    assert rows[2]["envelope"]["structured_data.ex@1.es"] == 'A"p]' and rows[2]["message"] == "msg here" and rows[1]["envelope"]["procid"] is None
    assert rows[4]["envelope"]["procid"] == "230" and rows[0]["envelope"]["facility_name"] == "local7"


def test_structured_data_ends_at_its_closing_quote(spark):
    line = r'<13>1 2024-01-01T00:00:00Z h a p m [x@1 p="C:\\dir\\" q="say \"hi\"" r="\]"] text'
    row = envelope.strip_syslog(spark.createDataFrame([(line,)], "text string")).first()
    assert {k.rsplit(".", 1)[1]: v for k, v in row["envelope"].items() if k.startswith("structured_data.")} == {"p": "C:\\dir\\", "q": 'say "hi"', "r": "]"}


def test_deep_json_is_flattened(spark):
    depth = 1200
    line = '{"a":' * depth + "1" + "}" * depth
    got = parsed(spark, "json", [line])[0][0]
    assert got is None or ".".join(["a"] * depth) in got


def test_payloads(spark):
    df = spark.createDataFrame([(1, '[{"b":1,"a":2},"x"]'), (2, '{"a":1}\r\n\n[2]'), (3, "{bad")], "payload_id int, body string")
    rows = sorted((r["payload_id"], r["position"], r["raw"], r["error"]) for r in explode_payloads(df, "json").collect())
    assert rows == [(1, 0, '{"a":2,"b":1}', None), (1, 1, '"x"', None), (2, 0, '{"a":1}', None), (2, 1, "[2]", None), (3, 0, None, "invalid JSON")]
    hec = spark.createDataFrame([(1, ' {"event":"e","sourcetype":"s"}\n{"event":{"z":1,"a":"é"}} '), (2, '{"event":1}{"x":1}')], "payload_id int, body string")
    got = explode_payloads(hec, "hec").collect()
    assert [(r["raw"], r["sourcetype"]) for r in got if r["payload_id"] == 1] == [("e", "s"), ('{"a":"é","z":1}', None)]
    assert [r["error"] is not None for r in got if r["payload_id"] == 2] == [True]
