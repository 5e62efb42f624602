"""Formats on small files, archives, mail, strings, and streams."""

import gzip
import io
import json
import zipfile

from pyspark.sql import functions as F

from emberlog.operators import normalize
from emberlog.operators.report import write_events
from emberlog.schema import EVENT
from emberlog.sources import binary, delimited, fingerprint, lines, records
from emberlog.streaming import ingest


def written(tmp_path, name, body):
    path = tmp_path / name
    path.write_bytes(body if isinstance(body, bytes) else body.encode())
    return str(path)


def test_lines_and_syslog(spark, tmp_path):
    path = written(tmp_path, "auth.log", "Aug 11 03:14:47 bastion sshd[7]: Failed password for invalid user bob from 45.83.140.22 port 22 ssh2\n\n<38>1 2026-08-11T03:14:48Z h sudo 9 - - ann : TTY=p ; USER=root ; COMMAND=/bin/bash\njunk\n")
    own = lines.read_lines(spark, path)
    assert [r["id_seq"] for r in own.orderBy("id_seq").collect()] == [0, 2, 3]
    rows = lines.syslog(own, 2026, "2030-01-01").orderBy("id_seq").collect()
    assert (rows[0]["user"], rows[0]["fields"]["src_ip"], rows[0]["fields"]["result"]) == ("bob", "45.83.140.22", "Failed")
    assert rows[1]["fields"]["command"] == "/bin/bash" and rows[1]["fields"]["facility"] == "4" and rows[2]["fields"] == {"parse_error": "unmatched"}
    events = normalize.normalize(lines.syslog(own, 2026, "2030-01-01"), "syslog").orderBy("id_seq").collect()
    assert events[2]["ts"] == events[1]["ts"] and "sshd[7]" in events[0]["entities"] and set(events[0].asDict()) == set(EVENT.names)


def test_documents_trails_and_audits(spark, tmp_path):
    trail = {"Records": [{"eventTime": "2026-08-11T03:20:00Z", "eventSource": "signin", "eventName": "ConsoleLogin", "awsRegion": "eu", "sourceIPAddress": "45.83.140.22", "userIdentity": {"type": "IAMUser", "userName": "ann"}, "additionalEventData": {"MFAUsed": "No"}, "responseElements": {"ConsoleLogin": "Success"}}, {"eventName": "DeleteTrail", "errorCode": "AccessDenied", "userIdentity": {"type": "Root"}}]}
    found = records.json_documents(spark, written(tmp_path, "trail.json", json.dumps(trail)))
    rows = records.cloud_trail(found, 2026, "2030-01-01").orderBy("id_seq").collect()
    assert rows[0]["fields"]["result"] == "success" and rows[0]["fields"]["MFAUsed"] == "no" and rows[0]["user"] == "ann" and rows[1]["sev"] == "medium"
    assert records.json_documents(spark, written(tmp_path, "one.json", '{"a": 1}')).count() == 1
    assert records.json_documents(spark, written(tmp_path, "list.json", "[1, 2, 3]")).count() == 3
    audit = {"kind": "Event", "apiVersion": "audit.k8s.io/v1", "stageTimestamp": "2026-08-11T03:30:00Z", "verb": "create", "user": {"username": "ann"}, "objectRef": {"resource": "pods", "subresource": "exec", "namespace": "payments", "name": "api-1"}, "sourceIPs": ["1.2.3.4"], "responseStatus": {"code": 101}, "requestURI": "/x?command=sh&command=-c"}
    row = records.cluster_audit(spark.createDataFrame([("f", 0, json.dumps(audit))], "file string, id_seq long, raw string"), 2026, "2030-01-01").first()
    assert (row["fields"]["resource"], row["fields"]["pod"], row["fields"]["command"].strip()) == ("pods/exec", "api-1", "sh -c")
    bad = records.json_lines(spark.createDataFrame([("f", 0, "{no")], "file string, id_seq long, raw string"), 2026).first()
    assert bad["fields"] == {"parse_error": "json"}


def test_event_xml(spark, tmp_path):
    body = "<Events>" + "".join(f"<Event><System><Provider Name='Sec'/><EventID>{code}</EventID><Level>0</Level><Channel>Security</Channel><Computer>WIN1</Computer><TimeCreated SystemTime='2026-08-11T03:00:0{k}Z'/></System><EventData><Data Name='TargetUserName'>{user}</Data><Data Name='SubjectUserName'>bob</Data><Data Name='LogonType'>3</Data></EventData></Event>" for k, (code, user) in enumerate([(4624, "ann"), (4625, "WIN1$")])) + "</Events>"
    rows = records.event_xml(spark, written(tmp_path, "sec.xml", body), latest="2030-01-01").orderBy("ts").collect()
    assert [(r["user"], r["fields"]["LogonTypeName"], r["fields"]["EventID"]) for r in rows] == [("ann", "network", "4624"), ("bob", "network", "4625")] and rows[1]["sev"] == "medium"


def test_equal_scores_of_delimiters(spark):
    raws = ["a,b,c"] * 5 + ["a,b,c,d,e,f"] * 4 + ["a"] * 8  # 5 * 1.2 and 4 * 1.5 of 17 lines: equal, and the wider one counts
    guess = delimited.delimiter_guess(spark.createDataFrame([("f", i, x) for i, x in enumerate(raws)], "file string, id_seq long, raw string")).first()
    assert (guess["delimiter"], guess["columns"], round(guess["score"], 6)) == (",", 6, 0.352941)


def test_delimited(spark, tmp_path):
    body = "".join(f"2026-08-11 03:00:{k:02d}|fw-1|{'DENY' if k % 2 else 'ALLOW'}|10.0.0.5:{4000 + k}|45.83.140.22:443|tcp|len={k}\n" for k in range(20))
    own = lines.read_lines(spark, written(tmp_path, "fw.log", body))
    guess = delimited.delimiter_guess(own).first()
    assert (guess["delimiter"], guess["columns"]) == ("|", 7)
    cells = own.select("file", F.posexplode(F.split("raw", r"\|")).alias("pos", "value"))
    names = delimited.guess_roles(delimited.role_statistics(cells).collect())
    assert [names.get(i) for i in range(6)] == ["ts", "host", "action", "src", "dst", "proto"]
    row = delimited.headerless(own, "|", names, latest="2030-01-01").orderBy("id_seq").collect()[1]
    assert row["fields"] == {"ts": "2026-08-11 03:00:01", "host": "fw-1", "action": "DENY", "src": "10.0.0.5", "src_port": "4001", "dst": "45.83.140.22", "dst_port": "443", "proto": "tcp", "len": "1"} and row["sev"] == "low"
    assert fingerprint.fingerprint(own).first()["parser"] == "delimited"
    table = delimited.with_header(spark, written(tmp_path, "t.csv", 'Event Time,User Name,Message\n2026-08-11 03:00:00,ann,"two\nlines"\n'), latest="2030-01-01").first()
    assert table["user"] == "ann" and table["msg"] == "two\nlines" and table["ts"] is not None
    assert delimited.rename_fields(["Src IP", "odd name", "x"], ["src_ip"], {"x": "dst"}) == ["src_ip", "odd_name", "dst"]


def test_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/b.log", "two\n\nlines\n")
        z.writestr("../evil", "x")
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("c.log.gz", gzip.compress("wide".encode("utf-16")))
    written(tmp_path, "a.zip", outer.getvalue())
    written(tmp_path, "bad.zip", b"PK\x03\x04junk")
    found = binary.expand_archives(binary.read_files(spark, str(tmp_path))).cache()
    rows = {r["file"].split("/", 1)[-1].rsplit("a.zip", 1)[-1]: r for r in found.collect()}
    assert bytes(rows["!in.zip!deep/b.log"]["content"]) == b"two\n\nlines\n" and rows["!in.zip!../evil"]["error"] and bytes(rows["!c.log.gz!c.log"]["content"]) == b"wide"
    assert sum(r["error"] is not None for r in found.collect()) == 2 and binary.text_lines(found).count() == 3


def test_mail_and_strings(spark, tmp_path):
    mail = b"From: Ann <ann@corp.example>\nTo: bob@x.example\nReply-To: e@evil.example\nSubject: hi\nDate: Tue, 11 Aug 2026 03:00:00 +0000\nReceived: from a (8.8.4.4)\nReceived: from b (9.9.9.9)\nAuthentication-Results: spf=fail dkim=pass\n\nsee https://evil.example/login now\n"
    rows = spark.createDataFrame([("m.eml", bytearray(mail)), ("m.mbox", bytearray(b"From a\n" + mail + b"\nFrom b\n" + mail))], "file string, content binary")
    got = binary.mail(rows).collect()
    assert len(got) == 3 and got[0]["fields"]["src_ip"] == "9.9.9.9,8.8.4.4" and got[0]["fields"]["reply_to_mismatch"] == "true" and got[0]["sev"] == "medium" and got[0]["fields"]["url"] == "https://evil.example/login"
    data = b"\x00\x01aaaaaaaa\x02powershell -enc AAAA\x00" + "HKLM\\Software\\Run".encode("utf-16le")
    found = binary.strings(spark.createDataFrame([("d.bin", bytearray(data))], "file string, content binary")).orderBy("id_seq").collect()
    assert [r["fields"]["encoding"] for r in found] == ["ascii", "utf-16le"] and "powershell" in found[0]["fields"]["tags"] and found[1]["sev"] == "medium"


def test_streams(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()
    (source / "a.log").write_text("".join(f"2026-08-11T03:00:{k:02d}Z host x\n" for k in range(5)))
    q = ingest.land(spark, str(source), out, check, 2026, "2030-01-01").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(out).where("ts IS NOT NULL").count() == 5
    landed = spark.readStream.schema(spark.read.parquet(out).schema).parquet(out + "/batch=*")
    final = str(tmp_path / "events")
    q = ingest.replace_sources(landed, lambda df: lines.raw_events(df, 2026, "2030-01-01"), "raw", final, check + "2").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(final).count() == 5
    fewer = spark.createDataFrame(spark.read.parquet(final).limit(2).collect(), spark.read.parquet(final).schema)
    write_events(fewer, final)
    assert spark.read.parquet(final).count() == 2


def test_burst_alerts(spark, tmp_path):
    rows = spark.range(12).select(F.lit("k").alias("user"), F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("id"), F.timestamp_seconds(1_786_000_000 + F.col("id") * F.when(F.col("id") < 6, 1).otherwise(100)).alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ingest.burst_alerts(stream, "user", 10, 4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert [(r["id"], r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("e03", 4)]


def test_a_format_that_does_not_parse_is_demoted(spark):
    element = '<Event><System><EventID>4624</EventID></System></Event>'
    files = {
        "json": ['{"a": 1}'] * 10,
        "broken": ['{"a": oops "b"}'] * 10,
        "half": ['{"a": 1}'] * 5 + ['{"a": oops "b"}'] * 5,
        "transcript": ['{"text": "see ' + element + '"}'] * 6 + ['{"text": "no"}'] * 2,
        "element": [element] * 4,
        "elements over lines": ["<Event>", "<System>", "<EventID>1</EventID>", "</System>"],
        "words": ["plain words"] * 3,
    }
    rows = [(name, i, raw) for name, own in files.items() for i, raw in enumerate(own)] + [("empty", 0, "  ")]
    found = {r["file"]: (r["parser"], r["state"], r["demoted"]) for r in fingerprint.fingerprint(spark.createDataFrame(rows, "file string, id_seq long, raw string")).collect()}
    assert found == {
        "json": ("app.jsonl", "READY", []), "broken": ("text", "READY", ["app.jsonl"]), "half": ("app.jsonl", "READY", []),
        "transcript": ("app.jsonl", "READY", []), "element": ("windows.evtx", "READY", []),
        "elements over lines": ("windows.evtx", "REVIEW", []), "words": ("text", "READY", []),
    }


def test_parsed_rows_go_back_in_bounded_frames():
    from emberlog.sources import binary

    groups = list(binary._grouped((i, 10) for i in range(binary.FRAME_ROWS + 1)))
    assert [len(g) for g in groups] == [binary.FRAME_ROWS, 1] and [x for g in groups for x in g] == list(range(binary.FRAME_ROWS + 1))
    assert [len(g) for g in binary._grouped((i, binary.FRAME_BYTES) for i in range(3))] == [1, 1, 1]


def test_costly_parsers_deal_their_rows_to_all_tasks(spark):
    from emberlog.plans import format_queries

    for name in ("parse_mail", "parse_cluster_audit"):
        plan = format_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" in plan
