import re

from quarry.llm import pii
from quarry.llm.piiscan import scan

GIVEN = ["Mira", "Jonas", "Élodie", "Priya", "Tomas", "Wanda"]
FAMILY = ["Velhart", "O'Brennwick", "Søndermark", "Tallis-Korven", "Ozdrheim", "Plavique"]


def corpus():
    docs = []
    for i, (g, f) in enumerate((g, f) for g in GIVEN for f in FAMILY):
        bare = "".join(c for c in f.lower() if c.isalpha()).replace("ø", "o")
        mail = f"{g.lower().replace('é', 'e')}.{bare}@example.org"
        docs.append(f"Reviewed-by: {g} {f} <{mail}>")
        docs.append(f"| {g} {f} | {10 + i} Heron Lane | +44 7700 900 {100 + i} |")
        docs.append(f"Reported by {g} {f}. Ship it to {10 + i} Heron Lane, Larkham. On-call number is {'+1 202 555 01' if i % 2 == 0 else '+120255501'}{10 + i} until Monday.")
        docs.append("Reported by Nightly Runner, triaged by Search Crew. Hash Ring and Bloom Filter pages were merged.")
        docs.append(f"On-call number is 030 / 231250{10 + i} until Monday. national id: {'942-25-83' + str(10 + i) if i % 2 == 0 else '828736' + str(10 + i) + 'G'}")
        docs.append(f"national id: T02 G{600 + i}-470J")
        docs.append("Ticket AB-1234567, build A12-B345-678, tag 99-10-2031. There are 12 Index Lanes here. Clone git@code.example:a/b.git from ssh://git@hub.invalid/x")
    docs.append("I think Velhart, Mira already said so. DORIN PLAVIQUE knows. Dr. Jonas van der Plavique left. Frau Wanda Pedra Tallis can see it.")
    docs.append("Mail Priya.Plavique@Example.Org if it fails. national id: QQ 53 33 34 A. On-call number is 030 / 23125099 A field.")
    docs.append("mail: mira.velhart at kiosk dot example or jonas [at] post [dot] example")
    return [*docs, "", None]


def test_found_and_redacted(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, value string")
    pieces = pii.personal_data(docs)
    got = {}
    for r in pieces.collect():
        assert texts[r.doc_id][r.start : r.stop] == r.value
        got.setdefault(r.doc_id, set()).add((r.pii_type, r.value))
    assert got[0] == {("name", "Mira Velhart"), ("email", "mira.velhart@example.org")}
    assert got[1] == {("name", "Mira Velhart"), ("address", "10 Heron Lane"), ("phone", "+44 7700 900 100")}
    assert got[2] == {("name", "Mira Velhart"), ("address", "10 Heron Lane"), ("phone", "+1 202 555 0110")}
    assert 3 not in got and 6 not in got
    assert got[4] == {("phone", "030 / 23125010"), ("id_number", "942-25-8310")}
    assert got[5] == {("id_number", "T02 G600-470J")}  # a format that no seed has, found by its context
    n = len(texts)
    assert got[n - 4] == {("email", "Priya.Plavique@Example.Org"), ("id_number", "QQ 53 33 34 A"), ("phone", "030 / 23125099")}
    assert got[n - 5] >= {("name", "Velhart, Mira"), ("name", "Jonas van der Plavique")}
    assert got[n - 3] == {("email", "mira.velhart at kiosk dot example"), ("email", "jonas [at] post [dot] example")}
    clean = {r.doc_id: r for r in pii.redacted(docs, pieces).collect()}
    assert clean[1].text == "| <NAME> | <ADDRESS> | <PHONE> |" and clean[1].n_pieces == 3
    assert clean[3].text == texts[3] and clean[n - 2].text == "" and clean[n - 1].text is None


def test_a_confident_pattern_finds_unseen_instances_of_every_family(spark):
    texts = [t for t in corpus() if t]
    mails = ["Mira", "Jonas", "Priya"]
    for i, (g, f) in enumerate((g, f) for g in mails for f in FAMILY):
        texts += [f"Owner on duty: {g} {f}, desk {i}.", f"Mailing to address: {10 + i} {('Heron', 'Alder', 'Wren')[i % 3]} Lane, then."]
    seen = len(texts)
    texts += ["Next week owner on duty: Quirin Vastholm; room free.", "Old national id: 77-4412-9035-Z; room free.", "Mailing to address: Ufersteg Morgenrot 14; room free."]
    texts += ["Table layout\nPort Tamsin\nend"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id - seen, r.pii_type, r.value) for r in pii.personal_data(docs).collect() if r.doc_id >= seen}
    assert got == {(0, "name", "Quirin Vastholm"), (1, "id_number", "77-4412-9035-Z"), (2, "address", "Ufersteg Morgenrot 14")}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_data(docs).count() == 0


def test_addresses_as_written():
    def values(text):
        return [text[r[2] : r[3]] for r in scan(text) if r[0] == "address" and r[-1]]

    assert values("address: 101B Dovecote Close, Larkham") == ["101B Dovecote Close"]
    assert values("au 136 bis, avenue du Lavoir Le journal") == ["136 bis, avenue du Lavoir"]
    assert values("| Calle del Fresno, 220 | C/ Molino Viejo n.º 54 |") == ["Calle del Fresno, 220", "C/ Molino Viejo n.º 54"]
    assert values("in Kranichstraße 37 b im Hof") == ["Kranichstraße 37 b"]
    assert values("213 Tallow St. Recall went; 33 Copperfield Rd.") == ["213 Tallow St.", "33 Copperfield Rd"]


def test_long_house_numbers_and_addresses_of_mail_far_away():
    rows = scan("They moved to 12345 Heron Lane and then to Reiherstraße 12875 in spring.")
    assert [(r[0], r[5], r[11]) for r in rows if r[0] == "address"] == [("address", "heronlane", "address"), ("address", "reiherstrasse", "address")]
    far = "Mira Velhart wrote this. " + "It says nothing at all. " * 60 + "Write to mira.velhart@example.org about it."
    assert [r[11] for r in scan(far) if r[0] == "name" and r[5] == "mira"] == ["name"]


def test_no_plan_of_the_driver_is_large(spark):
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    plans = spark._jsparkSession.sharedState().statusStore()

    def executions():
        listed = plans.executionsList()
        return {e.executionId(): e for e in map(listed.apply, range(listed.size()))}

    before = max(executions(), default=-1)
    assert pii.personal_data(docs).count() > 0
    sizes = [len(re.findall(r"(?m)^\(\d+\) ", e.physicalPlanDescription())) for k, e in executions().items() if k > before]
    # each finished stage plans the rest of its query anew: the driver's memory follows the largest plan
    assert len(sizes) > 5 and max(sizes) <= 120, sizes
