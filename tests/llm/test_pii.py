"""Personal information: kinds, edges, offsets through disguises, decoys."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as some

from gridloom.llm.pii import Plain, find, mentions, redact, redacted

FOUND = [
    ("Write to jane.doe+x@mail.example.org. Thanks", [("email", "jane.doe+x@mail.example.org")]),
    ("e-mail j_doe AT mail DOT example DOT net.", [("email", "j_doe AT mail DOT example DOT net")]),
    ("to info [at] example [dot] com oder", [("email", "info [at] example [dot] com")]),
    ("bids(at)a-b.example, x", [("email", "bids(at)a-b.example")]),
    ("ask jane dot doe at example dot org today", [("email", "jane dot doe at example dot org")]),
    ("mail jаne@exаmple.org", [("email", "jаne@exаmple.org")]),
    ("Contact: Grace O'Marrin, tel. +44 (0)7700 900851, e-mail", [("name", "Grace O'Marrin"), ("phone", "+44 (0)7700 900851")]),
    ("tel. (206)555‑0130 ext. 7", [("phone", "(206)555‑0130")]),
    ("Tel. +49 30 23125-670, x", [("phone", "+49 30 23125-670")]),
    ("tél. 01 99 00 62 20.", [("phone", "01 99 00 62 20")]),
    ("please call five five five oh one two three now", [("phone", "five five five oh one two three")]),
    ("SSN 979.35.0230 was", [("id_number", "979.35.0230")]),
    ("wrote the number 965156517 in the box for social security.", [("id_number", "965156517")]),
    ("National insurance no. DF 05 07 14 B belongs to N. E. Wexcombe.", [("id_number", "DF 05 07 14 B"), ("name", "N. E. Wexcombe")]),
    ("El DNI 02.047.014-G de M. C. Gantry debe ocultarse.", [("id_number", "02.047.014-G"), ("name", "M. C. Gantry")]),
    ("Die Steuer-ID 00/870/525514 von Lutz Weißgärtner ist zu schwärzen.", [("id_number", "00/870/525514"), ("name", "Lutz Weißgärtner")]),
    ("Passport ZZ2151317 was shown by Mrs Stonegrave at", [("id_number", "ZZ2151317"), ("name", "Stonegrave")]),
    ("lives at 83 N. Pelilhaven Ln. in Marelridge", [("address", "83 N. Pelilhaven Ln.")]),
    ("would shade 360B Zeluston Ave. Attendees: Lattice, Mark D.; McTorrow, R.. No", [("address", "360B Zeluston Ave"), ("name", "Lattice, Mark D."), ("name", "McTorrow, R.")]),
    ("Fait par Léa de La Brosserie, 11 bis avenue Ashoston, 31903 X", [("name", "Léa de La Brosserie"), ("address", "11 bis avenue Ashoston")]),
    ("Herr Hülsebrinck, wohnhaft Am Galilridge 34 in D", [("name", "Hülsebrinck"), ("address", "Am Galilridge 34")]),
    ("Dña. Ledesmoro, con domicilio en Avda. de Verimere n.º 67, V", [("name", "Ledesmoro"), ("address", "Avda. de Verimere n.º 67")]),
    ("Attendees: O&#39;Marrin, Dev &ndash; Eaveson, Y.\nNext", [("name", "O&#39;Marrin, Dev"), ("name", "Eaveson, Y.")]),
    ("Minutes taken by Brian  Wex-\ncombe. Then", [("name", "Brian  Wex-\ncombe")]),
    ("Contact : HervÃ© Roquevaire, tÃ©l.", [("name", "HervÃ© Roquevaire")]),
    ("According to Bri​an Abbots­ley, the", [("name", "Bri​an Abbots­ley")]),
]

NOTHING = [
    "The meter bears serial 892-531-6034 and was tested on 2029-12-17.", "Parcel 335-67-6629 was removed.", "plan no. 731-76-2866, and", "Docket EX21-4055-006 was opened on 9/10/2029.",
    "Turbine 9 stands at 32.58738, -104.82952 and", "The Mark Wexcombe Substation will be rebuilt.", "Nadia Penhalwyn Wind LLC holds the option.", "Curtailment on Grenilford Street feeders averaged 23 hours.",
    "Storage is priced @ EUR 885,455 per MW-month.", "Die Zählernummer 680 7808 84 wurde", "Le compteur n° 599 7756 11 a", "", "a combined value of £8,492,731.", "queue number 2019-AQ-2354-OE.",
]


@pytest.mark.parametrize(("text", "want"), FOUND)
def test_found(text, want):
    assert [(k, text[s:e]) for k, s, e in find(text)] == want


@pytest.mark.parametrize("text", NOTHING)
def test_nothing(text):
    assert find(text) == []


@settings(max_examples=300, deadline=None)
@given(some.text(alphabet="aé&;#3amp -\n​­\xa0Ã©'@.", max_size=60))
def test_offsets_stay_within_and_in_order(text):
    plain = Plain(text)
    last = 0
    for i in range(len(plain.text)):
        s, e = plain.source(i, i + 1)
        assert last <= s < e <= len(text)
        if plain.text[i].isalnum() and text[s:e].isalnum() and e - s == 1:
            assert plain.text[i] == text[s:e]
        last = e
    find(text)


def test_frames(spark, rows):
    long = "No comments were received. " * 40_000 + "SSN 979.35.0230 was"
    df = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "a@b.example"), (4, "a@b.example")], "d long, text string").selectExpr("*", "'x' AS key", "1 AS kind")
    at = long.index("979")
    assert rows(mentions(df, "d", "text")) == [(1, "id_number", at, at + 11), (4, "email", 0, 11), (4, "email", 0, 11)]
    assert rows(mentions(df.limit(0), "d", "text")) == []
    assert [r["redacted"] for r in redacted(df.where("d in (2, 4)"), "text").orderBy("d").collect()] == [None, "[EMAIL]", "[EMAIL]"]
    assert redact("see a@b.example now", find("see a@b.example now")) == "see [EMAIL] now"


@pytest.mark.parametrize(
    ("text", "kind", "said"),
    [
        ("Telefon: null eins sieben sechs eins zwei drei vier fünf, danke", "phone", "null eins sieben sechs eins zwei drei vier fünf"),
        ("Rufen Sie null dreißig einundzwanzig vierzig fünfundsechzig sieben an", "phone", "null dreißig einundzwanzig vierzig fünfundsechzig sieben"),
        ("joignable au zéro six douze trente-quatre soixante-dix-huit quatre-vingt-onze le soir", "phone", "zéro six douze trente-quatre soixante-dix-huit quatre-vingt-onze"),
        ("teléfono seis cinco cero, doce, treinta y cuatro, cincuenta y seis.", "phone", "seis cinco cero, doce, treinta y cuatro, cincuenta y seis"),
        ("ring 555 oh one double two now", "phone", "555 oh one double two"),
        ("ask for Jo; the office number: plus four four two zero seven nine four six oh one two three", "phone", "plus four four two zero seven nine four six oh one two three"),
        ("call me, when the meeting is over, on five five five oh one two three", "phone", "five five five oh one two three"),
        ("SSN nine seven nine three five oh two three oh was", "id_number", "nine seven nine three five oh two three oh"),
        ("El DNI cero dos cero cuatro siete cero uno cuatro debe", "id_number", "cero dos cero cuatro siete cero uno cuatro"),
        ("escriba a ana punto ruiz arroba ejemplo punto es hoy", "email", "ana punto ruiz arroba ejemplo punto es"),
        ("écrire à luc arobase exemple point fr ce soir", "email", "luc arobase exemple point fr"),
        ("an kai at beispiel punkt de senden", "email", "kai at beispiel punkt de"),
        ("tel.  fi\u200bve five five  oh one two three &amp; more", "phone", "fi\u200bve five five  oh one two three"),
    ],
)
def test_spoken_numbers_and_addresses(text, kind, said):
    assert [(k, text[s:e]) for k, s, e in find(text)] == [(kind, said)]


@pytest.mark.parametrize("text", ["one, two, three and four of them", "look at this point in time", "docket number one two three four five six seven eight", "from nineteen ninety-nine to twenty twenty", "in 12 of 100 cases, six or seven of 2024"])
def test_spoken_words_that_are_nothing(text):
    assert find(text) == []


def test_offsets_after_a_spoken_number():
    text = "call five five five oh one two three or a@b.example, then oh six one two three four five six seven eight, or c@d.example"
    assert [text[s:e] for _, s, e in find(text)] == ["five five five oh one two three", "a@b.example", "oh six one two three four five six seven eight", "c@d.example"]


@pytest.mark.parametrize(
    ("text", "kind", "said"),
    [
        ("mail " + "a" * 300 + "@b.example now", "email", "a" * 300 + "@b.example"),
        ("mail " + ".".join(["ab"] * 60) + " at " + " dot ".join(["cd"] * 60) + " dot org now", "email", ".".join(["ab"] * 60) + " at " + " dot ".join(["cd"] * 60) + " dot org"),
        ("x jo (dot) doe [at] mail {dot} example . org", "email", "jo (dot) doe [at] mail {dot} example"),
        ("an <max.muster @ firma.example>, bitte", "email", "max.muster @ firma.example"),
        ("lives at 12 North " + "Bee" * 30 + " Great" + "ham" * 20 + " Boulevard, X", "address", "12 North " + "Bee" * 30 + " Great" + "ham" * 20 + " Boulevard"),
        ("wohnt in " + "Lange" + "n" * 60 + "straße 5, X", "address", "Lange" + "n" * 60 + "straße 5"),
        ("demeurant 12 rue de la " + "Br" + "o" * 90 + ", 3", "address", "12 rue de la " + "Br" + "o" * 90),
        ("SSN " + "." * 40 + " 979.35.0230 was", "id_number", "979.35.0230"),
        ("please call, " + "when the meeting is over and all have gone home " * 4 + "five five five oh one two three", "phone", "five five five oh one two three"),
    ],
)
def test_nothing_is_cut_by_length(text, kind, said):
    assert [(k, text[s:e]) for k, s, e in find(text)] == [(kind, said)]


@pytest.mark.parametrize("text", ["at point of sale, priced @ 5 dot", "we met at noon. Dot org charts follow", "voir arobase"])
def test_no_address_in_disguise(text):
    assert find(text) == []


def test_offsets_after_a_disguised_address():
    text = "ask jo dot doe at example dot org, or a@b.example, SSN nine seven nine three five oh two three oh"
    assert [text[s:e] for _, s, e in find(text)] == ["jo dot doe at example dot org", "a@b.example", "nine seven nine three five oh two three oh"]
