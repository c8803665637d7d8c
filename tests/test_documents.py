"""Documents, records, MARC, archives and web sources."""

import gzip
import http.server
import io
import tarfile
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.functions import documents as D
from textloom.functions import marc as M
from textloom.functions import records as R
from textloom.sources import records as S
from textloom.sources import web

MENU = "<menu><meal><name>egg and <b>spam</b></name></meal><meal n='2'><name>spam</name></meal><meal><meal><name>inner</name></meal></meal></menu>"


def values(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_encodings_and_checksums(spark):
    row = values(
        spark,
        gz=D.decoded(D.gunzipped(D.gzipped(F.lit("spam"))), "UTF-8"),
        bz=D.decoded(D.bunzipped(D.bzipped(F.lit("spam")))),
        b64=D.to_base64(F.lit("spam")),
        back=D.decoded(D.from_base64(F.lit("c3BhbQ=="))),
        broken=D.gunzipped(F.lit("no gzip").cast("binary")),
        latin=D.decoded(F.lit(b"\xe9"), "ISO-8859-1"),
        md5=D.checksum(F.lit("spam")),
        sha=D.checksum(F.lit("spam"), "sha256"),
        words=D.word_count(F.lit(" a  b\nc ")),
        none=D.word_count(F.lit("  ")),
    )
    assert (row.gz, row.bz, row.b64, row.back, row.broken, row.latin) == ("spam", "spam", "c3BhbQ==", "spam", None, "é")
    assert row.md5 == "e09f6a7593f8ae3994ea57e1117f67ec" and row.sha.startswith("4e388ab3") and (row.words, row.none) == (3, 0)


def test_kinds(spark):
    rows = spark.createDataFrame([(b"%PDF-1.4",), (gzip.compress(b"x"),), (b"<?xml version='1.0'?><a/>",), (b" <!DOCTYPE html><p>",), (b"plain",), (b"\x00\x01\x02",), (None,)], "raw binary")
    assert [r[0] for r in rows.select(D.mime_type("raw")).collect()] == ["application/pdf", "application/gzip", "text/xml", "text/html", "text/plain", "application/octet-stream", None]
    by = {"text/html": lambda c: F.lit("page"), "*": lambda c: F.lit("other")}
    assert [r[0] for r in rows.select(D.redirected(D.mime_type("raw"), "raw", by)).collect()][3:5] == ["page", "other"]


@pytest.mark.parametrize(
    "make, text, want",
    [
        (D.lone_ampersands, "a & b &amp; c &#38; d&e", "a &amp; b &amp; c &#38; d&amp;e"),
        (D.text_to_xml, "a < b & c", "<data>a &lt; b &amp; c</data>"),
        (lambda c: D.sgml_to_xml(c, ["br"]), "<!DOCTYPE x SYSTEM 'y'><P Align=left>a & b<BR>c</P><?pi x?>", '<p align="left">a &amp; b<br/>c</p>'),
        (D.html_to_xml, "<p>one<p class=x>two<br><b>three", '<html><p>one</p><p class="x">two<br/><b>three</b></p></html>'),
        (D.printable, "a\x01b{é}“q”", "a b&#123;&#233;&#125;&quot;q&quot;"),
        (lambda c: D.printable(c, strip=True), "a\x0bb{é}", "a b"),
        (D.numeric_references, "&eacute; &163; &frac38; &#12; &unknown;", "&#233; &#163; 3&#8260;8  &unknown;"),
        (lambda c: D.regexp_smashed(c, "<script>.*?</script>"), "a<script>x\ny</script>b", "ab"),
        (lambda c: D.regexp_smashed(c, "[0-9]+", keep=True), "a1b22", "122"),
    ],
)
def test_markup(spark, make, text, want):
    assert values(spark, x=make(F.lit(text))).x == want
    assert values(spark, x=make(F.lit(None).cast("string"))).x is None


def test_mail_and_envelopes(spark):
    mail = "From: a@example.org\nSubject: x < y\nContent-Type: text/plain; charset=utf-8\n\nHello & bye"
    row = values(spark, mail=D.email_to_xml(F.lit(mail)), mets=D.mets_wrapped(F.lit("spam"), F.lit("n1")))
    assert "<Subject>x &lt; y</Subject>" in row.mail and "Hello &amp; bye</body>" in row.mail
    assert 'OBJID="n1"' in row.mets and "c3BhbQ==" in row.mets
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a.txt", "spam")
    assert 'OWNERID="a.txt"' in values(spark, x=D.zip_to_mets(F.lit(raw.getvalue()))).x


def test_piping(spark):
    rows = spark.createDataFrame([("b\na\n",), (None,)], "t string")
    assert [r.t for r in D.piped(rows, "t", ["sort"]).collect()] == ["a\nb\n", None]
    assert D.piped(rows, "t", ["false"]).first().t is None


def test_paths_take_the_whole_text(spark):
    rows = spark.createDataFrame([(1, MENU), (2, "<broken"), (3, None), (4, "<t>The <b>bold</b> egg</t>")], "k int, x string")
    got = {r.k: r.t for r in rows.select("k", R.texts("x", ["name", "//meal/@n"]).alias("t")).collect()}
    assert got == {1: ["egg and spam", "spam", "inner", "2"], 2: [], 3: None, 4: []}
    assert rows.where("k = 4").select(R.texts("x", "t")).first()[0] == ["The bold egg"]
    assert [r[0] for r in rows.select(R.well_formed("x")).collect()] == [True, False, None, True]
    terms = R.extracted_terms(spark.createDataFrame([(1, "<r><data>spam</data><data>spam</data></r>")], "k int, x string"), "k", "x", "data").collect()
    assert [(r.text, r.occs, r.elems) for r in terms] == [("spam", 2, [1, 2])]
    spaced = values(spark, x=R.texts(F.lit("<a>one<br/>two</a>"), "a", spaced=("br",)), n=R.texts(F.lit("<a xmlns:q='urn:q'><q:b>x</q:b></a>"), "q:b", namespaces={"q": "urn:q"}))
    assert spaced.x == ["one  two"] and spaced.n == ["x"]


def test_components_nest(spark):
    rows = spark.createDataFrame([(1, MENU), (2, "<div>a<div>b</div>c</div>"), (3, None)], "k int, x string")
    got = R.components(rows, "k", "x", ["meal", "div"]).collect()
    assert sum(r.k == 1 for r in got) == 4
    assert [r.component for r in got if r.k == 2] == ["<div>a<div>b</div>c</div>", "<div>b</div>"]


def test_spans(spark):
    record = F.lit("<d><hr/>spam<hr/> egg <i>and</i> sausage<hr/>tail</d>")
    row = values(spark, same=R.span_texts(record, "hr", "hr"), other=R.span_texts(F.lit("<d><s/>one<e/>x<s/>two <b>three</b><e/></d>"), "s", "e"))
    assert row.same == ["spam", "egg and sausage", "tail"] and row.other == ["one", "two three"]


def test_tei_and_tagged_records(spark):
    tei = "<text><p>A <sic corr='word'>wrod</sic> and <abbr expan='doctor'>Dr</abbr></p><p><uc>caps</uc> cut- off<figDesc>no</figDesc></p></text>"
    tagged = "<s><toks><w p='NN' s='cat' o='0'>cats</w><w p='VB' s='sit' o='5'>sat</w></toks></s>"
    row = values(spark, tei=R.tei_text(F.lit(tei)), tagged=R.tagged_terms(F.lit(tagged)), marked=R.corpus_markup(F.lit("a b"), F.lit(7)))
    assert row.tei == "A word and doctor CAPS cutoff"
    assert [tuple(x) for x in row.tagged] == [("cats", "NN", "cat", 0), ("sat", "VB", "sit", 5)]
    assert row.marked == '<s eid="7"><txt>a b</txt><toks><w o="0">a</w><w o="2">b</w></toks></s>'


def test_presentation(spark):
    row = values(
        spark,
        made=R.templated("Title: {t}.", t=F.lit("Spam")),
        marked=R.highlighted(F.lit("Spam, spammer and SPAM"), ["spam"]),
        at=R.highlighted_at(F.lit("egg and spam"), F.array(F.lit(0), F.lit(8))),
    )
    assert row.made == "Title: Spam." and row.marked == "<em>Spam</em>, spammer and <em>SPAM</em>" and row.at == "<em>egg</em> and <em>spam</em>"


RECORD = {"leader": "00000nam a2200000 a 4500", "fields": [{"tag": "001", "ind": None, "data": "id7", "subfields": []}, {"tag": "245", "ind": "10", "data": None, "subfields": [{"code": "a", "value": "Spam & Égg"}, {"code": "c", "value": "Ann"}]}]}


def test_marc(spark, tmp_path):
    raw = M.write_fields(RECORD)
    (tmp_path / "x.mrc").write_bytes(raw * 3)
    rows = S.load(spark, str(tmp_path / "x.mrc"))
    assert rows.count() == 3
    row = rows.select(M.fields("raw").alias("f"), M.to_xml("raw").alias("xml"), M.to_sgml("raw").alias("sgml"), M.from_xml(M.to_xml("raw")).alias("back")).withColumn("title", M.values(F.col("f"), "245", "a")).first()
    assert row.title == ["Spam & Égg"] and 'ind1="1"' in row.xml and "<fld245><a>Spam &amp; Égg<c>Ann</fld245>" in row.sgml
    assert bytes(row.back) == raw
    assert values(spark, x=M.to_xml(F.lit(b"nothing"))).x is None


def test_archives_and_files(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name in ("one.txt", "d/two.txt"):
            data = name.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("three.txt", "three")
    (tmp_path / "broken.zip").write_bytes(b"PK nothing")
    got = {r.member: bytes(r.content) for r in S.load(spark, str(tmp_path / "a.tar.gz")).collect()}
    assert got == {"one.txt": b"one.txt", "d/two.txt": b"d/two.txt"}
    assert [r.member for r in S.archive_documents(spark, str(tmp_path), "zip", "*.zip").collect()] == ["three.txt"]
    (tmp_path / "r.xml").write_text("<all>junk<rec n='1'>a<b/></rec><other/><rec/></all>")
    assert [r.record for r in S.xml_documents(spark, str(tmp_path / "r.xml"), "rec").collect()] == ["<rec n='1'>a<b/></rec>", "<rec/>"]
    assert S.xml_records(spark, str(tmp_path / "r.xml"), "rec").count() == 2
    assert S.load(spark, str(tmp_path), "dir").count() == 4
    S.register_format("upper", lambda spark, path: S.line_documents(spark, path).select(F.upper("line").alias("line")))
    assert S.load(spark, str(tmp_path / "r.xml"), "upper").first().line.startswith("<ALL>")
    with pytest.raises(ValueError):
        S.load(spark, str(tmp_path), "none")


def test_streams_out_of_rows(spark):
    rows = spark.createDataFrame([("x", "a", 1), ("x", "a & b", 2), ("y", "c", 3), (None, "d", 4)], "k string, v string, n int")
    got = {r.key: r.cluster for r in S.clusters(rows, F.col("k"), v=F.col("v")).collect()}
    assert got == {"x": "<cluster><key>x</key><v>a</v><v>a &amp; b</v></cluster>", "y": "<cluster><key>y</key><v>c</v></cluster>"}
    assert {r.k: r.document for r in S.accumulated(rows.where("k is not null"), "k", "n", "v").collect()} == {"x": "a\na & b", "y": "c"}
    assert S.term_documents(spark.createDataFrame([(1, ["a", "b"])], "k int, t array<string>"), "k", "t").count() == 2


def test_files_are_consumed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo\n")
    stream = S.consumed_documents(spark, str(tmp_path / "in"))
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


class _Server(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        from urllib.parse import parse_qs, urlsplit

        asked = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
        if "startRecord" in asked:
            start, n = int(asked["startRecord"]), int(asked["maximumRecords"])
            inner = "".join(f"<record><recordData><r>{i}</r></recordData></record>" for i in range(start, min(start + n, 8)))
            body = f"<searchRetrieveResponse><numberOfRecords>7</numberOfRecords><records>{inner}</records></searchRetrieveResponse>"
        else:
            late = "resumptionToken" in asked
            ids = ["c"] if late else ["a", "b"]
            inner = "".join(f"<record><header{' status=\"deleted\"' if i == 'b' else ''}><identifier>{i}</identifier><datestamp>2020</datestamp></header>{'' if i == 'b' else '<metadata><r/></metadata>'}</record>" for i in ids)
            body = f"<OAI-PMH><ListRecords>{inner}{'' if late else '<resumptionToken>t</resumptionToken>'}</ListRecords></OAI-PMH>"
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *_):
        pass


def test_web_services_page_by_page(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    web.register(spark)
    url = f"http://127.0.0.1:{server.server_port}/"
    rows = spark.read.format("sru").option("url", url).option("query", "spam").option("size", "3").load()
    assert sorted((r.position, r.record) for r in rows.collect()) == [(i, f"<r>{i}</r>") for i in range(1, 8)]
    got = spark.read.format("oai").option("url", url).load().collect()
    assert sorted((r.identifier, r.deleted, r.record is None) for r in got) == [("a", False, False), ("b", True, True), ("c", False, False)]
    server.shutdown()
