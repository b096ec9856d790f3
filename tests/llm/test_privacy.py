"""Personal information in sentences that the rules were not written from, beside the texts of the test data."""

from mnemosa.llm.privacy import find_personal
from mnemosa.llm.queries import _texts
from mnemosa.sources.tables import read_table

# Names that no table lists; the corpus introduces each somewhere, as letters and chats do.
NAMES = ["Orlaith", "Thaddeus", "Nkechi", "Bronagh", "Aurelio", "Siegrun", "Blandine", "Casimir"]
INTRODUCED = [f"My name is {n}." for n in NAMES] + [f"Hello, this is {n}." for n in NAMES]
HELD_OUT = {
    "Yesterday Orlaith brought soup for everyone.": {("NAME", "Orlaith")},
    "We left before Thaddeus came home.": {("NAME", "Thaddeus")},
    "The tickets are with Nkechi until noon.": {("NAME", "Nkechi")},
    "Nobody had told Bronagh about the party.": {("NAME", "Bronagh")},
    "Aurelio cooks on Sundays.": {("NAME", "Aurelio")},
    "Der Schlüssel liegt bei Siegrun im Büro.": {("NAME", "Siegrun")},
    "Le chat de Blandine dort toujours.": {("NAME", "Blandine")},
    "Hoy Casimir no viene a clase.": {("NAME", "Casimir")},
    "Forward the bill to orlaith.finn@wexmail.test by Friday.": {("EMAIL", "orlaith.finn@wexmail.test")},
    "Drop a line: t.moss (at) harbourpost (dot) test": {("EMAIL", "t.moss (at) harbourpost (dot) test")},
    "My mobile is +44 7700 900123, ring after six.": {("PHONE", "+44 7700 900123")},
    "Sie erreichen mich telefonisch unter +49 30 901820.": {("PHONE", "+49 30 901820")},
    "Appelle le +33 1 70 18 99 00 demain.": {("PHONE", "+33 1 70 18 99 00")},
    "She moved to 17 Fennel Street last spring.": {("ADDRESS", "17 Fennel Street")},
    "Unsere Adresse ist Lindenweg 8, 99999 Musterdorf.": {("ADDRESS", "Lindenweg 8, 99999 Musterdorf")},
    "My passport number is K1234567Z, keep it safe.": {("ID", "K1234567Z")},
    "My social security number is 123-45-6789.": {("ID", "123-45-6789")},
    "The meeting starts at 10:30 in room 12.": set(),
    "Version 3.4.1 fixed 1,200 rows since 2023-04-05.": set(),
    "Der Zug nach Bremen hat Verspätung.": set(),
    "Spring is late and the river is high.": set(),
    "Le musée ferme à dix-huit heures.": set(),
}


def test_held_out_sentences(spark, small):
    mid = small.replace("sf0.001", "sf0.01")
    mine = spark.createDataFrame([("held", str(i), t) for i, t in enumerate(HELD_OUT)] + [("told", str(i), t) for i, t in enumerate(INTRODUCED)], "field string, uuid string, text string")
    found = find_personal(_texts(spark, mid).unionByName(mine), read_table(spark, mid, "given_name")).filter("field = 'held'").collect()
    got = {(int(r.uuid), r.kind, r.found_text) for r in found}
    want = {(i, *x) for i, items in enumerate(HELD_OUT.values()) for x in items}
    texts = list(HELD_OUT)
    assert len(got & want) >= 0.8 * len(want), [(texts[i], k, t) for i, k, t in want - got]
    assert len(got & want) >= 0.9 * len(got), [(texts[i], k, t) for i, k, t in got - want]
