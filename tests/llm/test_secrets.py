import re

from pyspark.sql import functions as F

from riskloom.llm import secrets
from riskloom.llm.staging import stage

from .helpers import awkward, awkward_rows, empty

PATTERNS = {
    "assign": (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20), "hex": (re.compile(r"[0-9a-f]+"), 0, 24)}
TEXTS = ["token = \"abc123def\" and TOKEN:short1", "token: ab token:abcdefgh", "token:token:abcdefgh", "AKIA" + "A" * 15 + " AKIA" + "B" * 16,
         "AKIAAKIA" + "C" * 14, "é" * 5 + "password='" + "f" * 30 + "'", "deadbeef" * 3 + " " + "deadbeef" * 2, "secret=" + "0" * 24,
         "漢字 api_key: x+/_.=-9 apikey=ABCDEF", "no secrets", "", None, ("token = 0123456789 " * 3000), "passwd = " + "a" * 100_000]


def brute(text):
    out = []
    for rank, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        out += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def spans(row):
    return [(s.start, s.end, s.kind) for s in row.findings]


def test_spans_equal_a_plain_search(spark):
    docs = frame(spark).withColumn("findings", F.lit(7)).withColumn("blob", F.lit("kept"))
    got = secrets.findings_by_row(docs, secrets.update_ledger(docs)).collect()
    assert len(got) == len(TEXTS) and got[0].blob == "kept"
    for r in got:
        assert spans(r) == brute(r.text)


def test_awkward_rows_and_empty_tables(spark):
    docs = awkward(spark)
    got = secrets.findings_by_row(docs, secrets.update_ledger(docs)).collect()
    assert len(got) == len(awkward_rows()) and all(spans(r) == brute(r.text) for r in got)
    assert secrets.update_ledger(empty(spark)).count() == 0 and secrets.redact(empty(spark)).count() == 0


def test_ledger_scans_each_blob_and_rule_version_once(spark):
    first = frame(spark, TEXTS[:8] + TEXTS[:3])
    ledger = stage(secrets.update_ledger(first), "ledger")
    assert ledger.count() == 8 * 3 and ledger.select("blob", "rule").distinct().count() == 8 * 3
    later = frame(spark, TEXTS[4:10])
    fresh = secrets.scan_blobs(later, ledger)
    seen = {bytes(r.blob) for r in ledger.collect()}
    assert fresh.count() == 2 * 3 and not seen & {bytes(r.blob) for r in fresh.collect()}
    assert secrets.scan_blobs(first, ledger).count() == 0
    newer = (secrets.Rule("hex", 2, r"[0-9a-f]{16,}"), *secrets.RULES[:2])
    assert {(r.rule) for r in secrets.scan_blobs(first, ledger, newer).collect()} == {"hex@2"}
    both = secrets.update_ledger(later, ledger)
    assert all(spans(r) == brute(r.text) for r in secrets.findings_by_row(later, both).collect())


def test_increments_scan_only_what_is_new(spark, monkeypatch):
    docs = frame(spark, TEXTS[:9] + TEXTS[2:12]).unionByName(frame(spark, [TEXTS[3]]).withColumn("doc_id", F.lit(None).cast("bigint")))
    scans, scan = [], secrets.scan_blobs
    monkeypatch.setattr(secrets, "scan_blobs", lambda *a: scans.append(scan(*a)) or scans[-1])
    parts = secrets.halves(docs)
    ledger = secrets.ledger_of(parts)
    first, second = ({r.text or "" for r in part.collect()} for part in parts)
    assert [s.select("blob").distinct().count() for s in scans] == [len(first), len(second - first)]
    assert ledger.count() == ledger.select("blob", "rule").distinct().count() == 3 * len(first | second)
    got = secrets.findings_by_row(docs, ledger).collect()
    assert len(got) == 20 and all(spans(r) == brute(r.text) for r in got)
    assert secrets.ledger_of(secrets.halves(empty(spark))).count() == 0


def test_redaction_masks_each_secret_and_leaves_the_rest(spark):
    docs = frame(spark).withColumn("source", F.lit("s"))
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        text, want, at = TEXTS[r.doc_id], [], 0
        for a, b, _ in brute(text):
            if a >= at:
                want += [text[at:a], secrets.MASK]
            at = max(at, b)
        assert r.text == (None if text is None else "".join(want) + text[at:])
