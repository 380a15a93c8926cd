"""Identifiers that only later rounds, glued spans or copies of documents bring out."""

from symscape.llm import pii


def found(spark, texts):
    """The text and kind of each finding."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(texts[r.doc_id][r.start : r.start + r.length], r.kind) for r in pii.findings(docs).collect()}


def test_discovered_instances_support_further_patterns(spark):
    texts = [f"call +49 30 12345{k:02d} now{k}" for k in range(30)] + [f"call 030/99{k}7 so{k}" for k in range(3)]
    texts += [f"ring +49 40 77788{k} well{k}" for k in range(4)] + [f"ring 030/99{k}7 then{k}" for k in range(3)]
    texts += ["ring 5-12-77-3 later"]
    got = found(spark, texts)
    assert {("030/9907", "phone"), ("030/9927", "phone")} <= got  # beside a word of many seeds
    assert ("5-12-77-3", "phone") in got  # beside a word of 4 seeds and of 3 instances found in the first round


def test_identifiers_glued_to_other_signs(spark):
    texts = ["(a@b.com)", "**c@b.com**", "email:d@b.com", "x,e@b.com,f@b.com", "10.0.0.1:8080", "ip=10.0.0.2", "208.240.42.236***", "4247042900896785$$$", "+1 (136) 555-7479%%%", "(+49 30 1234567)", "電話g@b.comです"]
    want = {(f"{x}@b.com", "email") for x in "acdefg"} | {(x, "ip") for x in ("10.0.0.1", "10.0.0.2", "208.240.42.236")} | {("4247042900896785", "card"), ("+1 (136) 555-7479", "phone"), ("+49 30 1234567", "phone")}
    assert found(spark, texts) >= want
    assert pii.spans("x1.2.3.4 and 1.2.3.4.5") == [(0, 8), (13, 22)]  # longer numbers hold no address


def test_copies_of_a_document_change_no_pattern(spark):
    texts = [f"call +49 30 12345{k:02d} now{k}" for k in range(30)] + ["call 030/9917 here"]
    copies = ["please call us at once"] * 200 + [texts[0]] * 200
    assert ("030/9917", "phone") in found(spark, texts + copies)
    rare = ["the +49 30 1234567"] * 300 + [f"the word{'xyzuv'[k % 5] * (k // 5 + 1)} stands" for k in range(60)] + [f"the +49 30 765432{k}" for k in range(4)] + ["the 12/9 end"]
    assert ("12/9", "phone") not in found(spark, rare)
