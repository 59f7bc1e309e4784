"""The tagger of personal information on text that shares neither phrases nor names with its table."""

import re
from collections import Counter

import pytest

from inkwright.llm import pii, pii_table

# {kind:value} marks a value
TEXTS = """
Our treasurer {name:Bettina Krause} keeps the minutes; her extension is listed under {phone:+43 1 588 01 4320}.
The parcel for {name:Tobias Lindgren} never reached {address:44 Copper Beech Lane, Ashbourne DE6 1GH}.
He gave {phone:(415) 867-5309} as a fallback number.
Complaints landed in {email:ombudsman@cityhall.example} over the weekend.
During the audit {name:Farah Al-Rashid} showed her passport, {id_number:C01X00T47}, at the counter.
After the talk, {name:Gareth Pugh} and {name:Mehmet Arslan} shared a taxi.
Payroll wants {name:Dolores Ibarra} to resend {id_number:078-05-1120}, the number the tax office asked for.
Nominations close Friday: mail {email:jury[at]filmfest[dot]example} with a trailer.
We rented a flat at {address:19 Juniper Crescent} for the summer school.
The plaque honours {name:Henrik Vestergaard}, who taught here for decades.
Phone {phone:020 7946 0018} and ask for {name:Priyanka Deshmukh}.
The landlord, {name:Colm Gallagher}, lives upstairs at {address:Flat 2, 310 Harbour Terrace, Galway}.
Lost badge? Tell {name:R. Castellano} at once.
{name:Okonkwo, Chinedu} and {name:Haverford, L.} disputed the claim.
Frau {name:Lieselotte Baumgartner} erreichen Sie mobil: {phone:0171 2345678}.
Die Akte liegt bei {name:Detlef Kruse}, {address:Rosengartenweg 7, 69118 Heidelberg}.
Bitte {email:buero@kanzlei-kruse.example} in Kopie setzen.
Madame {name:Solange Perrin} habite {address:27 rue des Carmes, 31000 Toulouse}.
Son portable est le {phone:06 39 98 12 45}.
请联系财务部的{name:周晓燕}，手机{phone:13912345678}。
快递员把包裹送到{address:南京市玄武区珠江路88号}。
经办人{name:欧阳志远}的身份证号是{id_number:320102198807124518}。
报名邮箱为{email:baoming@xiehui.example}。
{name:林静怡}老师主持了讨论。
Registered voters: {name:Ines Carvalho}, {name:Matteo Ferrante}, {name:Aoife Brennan}.
Her Spanish identity card reads {id_number:12345678Z}.
The minutes were taken by {name:Ulrich Zimmer} on behalf of the board.
Ping {email:ops-team@status.example} or call {phone:1-800-555-0199}.
Guests of {name:Tamsin Blackwood} should park behind {address:6 Mill Race Road}.
Emergency contact: {name:Pavel Dvořák}, {phone:+420 601 234 567}.
""".strip().split("\n")
NONE = """
The Krause criterion rejects 14 of 30 outliers.
Version 4.12.0 was tagged on 2023-11-05 with hash 9fe01c.
Boiling Springs and Ashbourne lie on the same railway.
Invoice 20231105 covers 3 licences.
Equation 12 holds for every x in the unit ball.
Toulouse and Heidelberg are twinned.
The ResNet block feeds a Swin stage, then a linear head.
会议讨论了第5章的公式与图表。
Die Tabelle auf Seite 12 ist leer.
On average, Bayesian Optimisation needs 40 trials.
""".strip().split("\n")


def parse(line):
    text, spans = "", []
    for part in re.split(r"(\{\w+:[^}]*\})", line):
        if m := re.fullmatch(r"\{(\w+):([^}]*)\}", part):
            spans.append((len(text), m[1]))
            text += m[2]
        else:
            text += part
    return text, spans


@pytest.fixture(scope="module")
def model():
    return pii.fit()


def test_the_texts_share_nothing_with_the_table():
    table = "\n".join(pii_table.LINES + pii_table.OPEN + pii_table.PLAIN)
    for line in TEXTS:
        for part in re.split(r"\{[^}]*\}", line):
            assert not any(part[i : i + 14] in table for i in range(max(len(part) - 13, 0))), part
    names = {w for line in TEXTS for v in re.findall(r"\{name:([^}]*)\}", line) for w in re.findall(r"\w{3,}", v) if w.isascii()}
    assert len(names & set(pii_table.GIVEN + pii_table.FAMILY)) <= 1


def test_independent_texts(model):
    """Recall and precision over sentences written for this test; the README gives them by kind."""
    hit, miss, extra = Counter(), Counter(), Counter()
    for line in TEXTS + NONE:
        text, spans = parse(line)
        got = {(a, k) for a, _, k in pii.tag([text], model)[0]}
        for s in spans:
            (hit if s in got else miss)[s[1]] += 1
        for s in got - set(spans):
            extra[s[1]] += 1
    print({k: (hit[k], miss[k], extra[k]) for k in pii.KINDS})
    assert sum(hit.values()) >= 0.7 * (sum(hit.values()) + sum(miss.values()))
    assert sum(extra.values()) <= 0.15 * sum(hit.values())


def test_held_out_lines_and_names():
    """A fit on four fifths of the lines and names, measured on the last fifth."""
    m = pii.fit(keep=(0, 1, 2, 3), parts=5)
    rows = pii_table.labelled(500, 77, (4,), 5)
    hit = miss = extra = 0
    for (_, spans), got in zip(rows, pii.tag_all([t for t, _ in rows], m)):
        a, b = {(x, k) for x, _, k in spans}, {(x, k) for x, _, k in got}
        hit, miss, extra = hit + len(a & b), miss + len(a - b), extra + len(b - a)
    print(hit / (hit + miss), hit / (hit + extra))
    assert hit / (hit + miss) > 0.8 and hit / (hit + extra) > 0.9


def test_sequences_end_where_no_value_goes_on(model):
    """Long texts are cut at such tokens; labels within don't depend on what lies beyond the reach of a feature."""
    line = "Write to Bettina Krause, 44 Copper Beech Lane. "
    many = pii.tag([(line + "\n\n") * 400], model)[0]
    n = len(line) + 2
    found = [{(a % n, k) for a, _, k in many if a // n == i} for i in range(1, 399)]
    assert found[0] and all(f == found[0] for f in found)
    tok = pii.Tokens([(line + "\n\n") * 400])
    assert max(pii._steps(tok.seq)[1]) < 20
