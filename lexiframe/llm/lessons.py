"""Made texts with known sentence units, from which the boundary model is fitted.

Sentences are composed from short lists of words, one list per language; texts string them together
with the gaps that occur between sentences. Thai sentences carry no marks.
"""

from __future__ import annotations

import random

NAMES = "Anna Boris Clara David Eva Felix Greta Hugo Irina Jonas Karin Leo Marta Nils Olga Pablo".split()
SURNAMES = "Archer Bellmann Costa Dorn Engel Fuchs Garcia Hansen Ivanov Jansen Keller Larsen".split()
PLACES = "Aldburg Brenthaven Cormoor Duneford Elmstead Farwick Gladebrook Hillmere".split()
NOUNS = "dog house teacher river letter garden window engine market table clock forest".split()
VERBS = "saw moved painted opened closed counted wrote carried changed followed".split()
ADJECTIVES = "old small green quiet heavy late common early".split()
TITLES = "Mr Mrs Dr Prof Capt Sgt St Gen Lt Rev".split()
MONTHS = "Jan Feb Mar Apr Aug Sept Oct Nov Dec".split()


def _english(r: random.Random) -> str:
    n, v, a, p, w = (lambda: r.choice(NOUNS)), (lambda: r.choice(VERBS)), (lambda: r.choice(ADJECTIVES)), (lambda: r.choice(PLACES)), (lambda: r.choice(NAMES))
    d = lambda: r.choice([str(r.randint(1, 99)), f"{r.randint(1, 99)}.{r.randint(1, 99)}", f"{r.randint(1, 9)},{r.randint(100, 999)}"])
    kinds = [
        lambda: f"The {a()} {n()} {v()} the {n()}.",
        lambda: f"The {a()} {n()} {v()} the {n()} in {r.randint(1900, 2020)}.",
        lambda: f"Did the {n()} {v()[:-1]} the {n()}{r.choice(['?', '??', '?!'])}",
        lambda: f"What a {a()} {n()}{r.choice(['!', '!!', '!!!'])}",
        lambda: f"{r.choice(TITLES)}. {r.choice(SURNAMES)} {v()} the {n()} in {p()}.",
        lambda: f"{r.choice('ABCDEFGHIJKLMNOPRSTUVW')}. {r.choice('ABCDEFGHIJKLMNOPRSTUVW')}. {r.choice(SURNAMES)} {v()} the {n()}.",
        lambda: f"The {n()} {v()} {d()} {n()}s, {n()}s, {n()}s, etc.",
        lambda: f"The {n()} {r.choice(['opened', 'closed', 'left'])} at {r.randint(1, 12)} {r.choice(['a.m.', 'p.m.'])}",
        lambda: f"The {p()} {r.choice(['Corp.', 'Inc.', 'Ltd.', 'Co.'])} {n()} {v()} {d()} {n()}s vs. {d()} last year.",
        lambda: f"The {n()} (see Fig. {r.randint(1, 9)} in the {a()} book) {v()} item No. {r.randint(1, 99)}.",
        lambda: f"The file {n()}.txt lists {r.choice(MONTHS)}. {r.randint(1, 28)} as the date; the {n()} {v()} it.",
        lambda: f"{w()}, a.k.a. the {a()} {n()}, {v()} the Ph.D. of {r.choice(SURNAMES)} on Mt. {r.choice(SURNAMES)}.",
        lambda: f"{r.choice(['About', 'Approx.', 'Some'])} {d()} {n()}s, {r.choice(['e.g.', 'i.e.', 'esp.', 'incl.'])} the {a()} ones, {v()} the {n()}.",
        lambda: f"The {r.choice('ABCDK')}.{r.choice('LMNR')}.{r.choice('TVX')}. {n()} {v()} the {n()}s.",
        lambda: f"The {n()} paused {r.choice(['…', '...', '. . .'])} and then {v()} the {n()}.",
        lambda: f"The {n()} {v()} the {n()}{r.choice(['…', '...'])}",
        lambda: f"See http://www.{n()}.example/{n()}.html?v={d()} for the {n()}s.",
        lambda: f"The price was ${d()} for v{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)} of the {n()}.",
        lambda: f"The {n()} (what for?) {v()} all of them (why not!) in {r.randint(1900, 2020)}.",
        lambda: f"(The {n()} in {p()} {v()} nothing.)",
        lambda: f"“We {v()} the {n()} and the {n()},” {w()} said in {p()}.",
        lambda: f"“{r.choice(['No!', 'Stop!', 'Will the ' + n() + ' come?', 'It rained. We ' + v() + ' the ' + n() + '!'])}” {r.choice(['cried', 'asked', 'shouted'])} {w()}, and the {n()} {v()} the {n()}.",
        lambda: f"\"It rained in {p()}. We {v()} the {n()},\" she said.",
        lambda: f"{w()} wrote, {r.choice(['“{}”', chr(34) + '{}' + chr(34)])}".format(f"The {n()} {v()} the {n()}{r.choice(['.', '!', '?'])}"),
        lambda: f"“He said ‘stop!’ and {v()} the {n()},” {w()} recalled.",
        lambda: r.choice(["So what?", "Right.", "Hm.", "Really?"]),
    ]
    return r.choice(kinds)()


def _of(parts: list[list[str]], r: random.Random, join: str = " ") -> str:
    return join.join(r.choice(p) for p in parts)


def _german(r: random.Random) -> str:
    s = _of([["Der Bäcker", "Die Lehrerin", "Das Amt", "Ein Nachbar"], ["sieht", "malt", "öffnet", "liest"], ["das Haus", "den Brief", "die Karte", "ein altes Buch"]], r)
    return r.choice(
        [
            lambda: s + r.choice([".", "!", "."]),
            lambda: f"Frau Dr. {r.choice(SURNAMES)} liest den Brief.",
            lambda: f"{s}, z. B. die Seiten der Nr. {r.randint(1, 50)}.",
            lambda: f"{s} um {r.randint(1, 40)},{r.randint(10, 99)} %.",
            lambda: f"{s} ... und geht dann heim.",
            lambda: f"{s} … und geht dann heim.",
            lambda: f"{r.choice(['Die', 'Der', 'Das'])} {r.randint(2, 40)}. {r.choice(['Runde', 'Abend', 'Spiel'])} beginnt am {r.randint(1, 28)}. {r.choice(['Mai', 'Juni', 'März'])}.",
            lambda: f"„Kommt das Buch?“, fragte {r.choice(NAMES)}.",
            lambda: f"{r.choice(NAMES)} schrieb: „{s}.“",
        ]
    )()


def _french(r: random.Random) -> str:
    s = _of([["Le voisin", "La boulangère", "L’école", "Un témoin"], ["regarde", "ouvre", "lit", "garde"], ["la maison", "le livre d’été", "une lettre", "l’histoire"]], r)
    return r.choice(
        [
            lambda: s + r.choice([".", "!", " !", " ?"]),
            lambda: f"M. {r.choice(SURNAMES)} lit une lettre.",
            lambda: f"{s}, p. ex. les pages du no. {r.randint(1, 40)}.",
            lambda: f"{s} {r.choice(['…', '...'])} et puis rentre.",
            lambda: f"« Où est la maison ? » demanda {r.choice(NAMES)}.",
            lambda: f"{r.choice(NAMES)} écrit : « {s}. »",
        ]
    )()


def _spanish(r: random.Random) -> str:
    s = _of([["El vecino", "La maestra", "La escuela", "Un testigo"], ["mira", "abre", "lee", "guarda"], ["la casa", "el libro", "una carta", "la historia"]], r)
    return r.choice(
        [
            lambda: s + r.choice([".", "!", "."]),
            lambda: f"¿{s}?",
            lambda: f"La Sra. {r.choice(SURNAMES)} lee una carta.",
            lambda: f"{s}, p. ej. las frases del núm. {r.randint(1, 40)}.",
            lambda: f"{s} {r.choice(['…', '...'])} y luego vuelve.",
            lambda: f"«¿Dónde está la casa?», preguntó {r.choice(NAMES)}.",
            lambda: f"{r.choice(NAMES)} escribió: «{s}.»",
        ]
    )()


def _chinese(r: random.Random) -> str:
    s = _of([["老人", "学校", "邻居", "作家"], ["看见了", "打开了", "整理了"], ["一本书", "一封信", "房子"]], r, "")
    return r.choice(
        [
            lambda: s + r.choice(["。", "！", "？"]),
            lambda: f"{s}，得分{r.randint(1, 30)}.{r.randint(10, 99)}。",
            lambda: f"{r.choice(['老人', '邻居'])}说：“{s}。”",
            lambda: f"“{s}{r.choice(['！', '？'])}”{r.choice(['老人', '邻居'])}喊道。",
            lambda: f"他想了想……还是{s}。",
        ]
    )()


def _japanese(r: random.Random) -> str:
    s = _of([["老人は", "学校は", "隣の人は"], ["本を", "手紙を", "家を"], ["見た", "開けた", "直した"]], r, "")
    return r.choice(
        [
            lambda: s + r.choice(["。", "！", "？"]),
            lambda: f"得点は{r.randint(1, 30)}.{r.randint(1, 99)}だった。",
            lambda: f"「{s}{r.choice(['。', '！', '？'])}」と{r.choice(['先生', '老人'])}は言った。",
            lambda: f"老人は「{s}。」と言った。",
        ]
    )()


def _arabic(r: random.Random) -> str:
    s = _of([["قرأ", "كتب", "فتح"], ["الرجل", "الجار", "الكاتب"], ["الكتاب", "الرسالة", "البيت"]], r)
    return r.choice([lambda: s + r.choice([".", "!"]), lambda: f"هل {s}؟", lambda: f"{s} بنسبة {r.randint(1, 30)}.{r.randint(10, 99)}.", lambda: f"قال د. الكاتب: «{s}.»"])()


def _hindi(r: random.Random) -> str:
    s = _of([["लड़के ने", "पड़ोसी ने", "माली ने"], ["किताब", "चिट्ठी", "घर का दरवाज़ा"], ["देखा", "खोला", "बनाया"]], r)
    return r.choice([lambda: f"{s}।", lambda: f"क्या {s}?", lambda: f"डॉ. {s}।", lambda: f"{s} और {r.randint(1, 30)}.{r.randint(10, 99)} अंक पाए।", lambda: f"“{s}।” पड़ोसी ने कहा।"])()


def _thai(r: random.Random) -> str:
    s = _of([["แม่ค้า", "เพื่อนบ้าน", "นักเขียน"], ["เปิด", "อ่าน", "เห็น"], ["หนังสือ", "จดหมาย", "บ้านเก่า"]], r, "")
    return r.choice([s, f"{s} {r.randint(1, 90)} เล่ม", f"{s}เป็นเวลา {r.randint(1, 90)} วัน"])


def _lao(r: random.Random) -> str:
    return _of([["ແມ່ຄ້າ", "ເພື່ອນບ້ານ", "ນັກຂຽນ"], ["ເປີດ", "ອ່ານ", "ເຫັນ"], ["ປຶ້ມ", "ຈົດໝາຍ", "ເຮືອນເກົ່າ"]], r, "")


def _khmer(r: random.Random) -> str:
    """Spaces part phrases; sentences end in a mark."""
    s = [_of([["គ្រូ", "អ្នកជិតខាង", "អ្នកនិពន្ធ"], ["អាន", "បើក", "ឃើញ"], ["សៀវភៅ", "សំបុត្រ", "ផ្ទះចាស់"]], r, "") for _ in range(r.randint(1, 3))]
    return " ".join(s) + r.choice(["។", "។", "៕"])


def _burmese(r: random.Random) -> str:
    s = [_of([["ဆရာမ", "အိမ်နီးချင်း", "စာရေးသူ"], ["စာအုပ်", "စာ", "အိမ်ဟောင်း"], ["ဖတ်သည်", "ဖွင့်သည်", "မြင်သည်"]], r, "") for _ in range(r.randint(1, 3))]
    return r.choice([" ", "၊ "]).join(s) + "။"


def _stray(r: random.Random) -> str:
    """Quotation marks that are none: inches, apostrophes, and a quotation that nobody closed."""
    n, v = r.choice(NOUNS), r.choice(VERBS)
    return r.choice(
        [
            lambda: f"The {n} {v} a {r.randint(2, 30)}\" {n} in {r.choice(PLACES)}.",
            lambda: f"In the ‘{r.randint(20, 90)}s the {n} {v} the {n}.",
            lambda: f"They {v} rock ‘n’ roll near the {n}.",
            lambda: f"The {n} {v} “the {n}.",
        ]
    )()


_ALL = [_english] * 5 + [_german, _french, _spanish, _chinese, _japanese, _arabic, _hindi, _thai, _lao, _khmer, _burmese]
_UNSPACED = (_chinese, _japanese)


def text(r: random.Random) -> tuple[str, list[int]]:
    """A text of one language and the ends of its units."""
    make = r.choice(_ALL)
    out, ends = "", []
    for _ in range(r.randint(2, 7)):
        s = _stray(r) if make is _english and r.random() < 0.02 else make(r)
        if make is _english and r.random() < 0.12 and s[-1] in ".?!" and not s[0] in "“\"(" and "…" not in s:
            s = s.lower()
            if out.rstrip().endswith(("…", "...", "etc.", "”", "\"")):
                s = s[0].upper() + s[1:]
        if out:
            glue = r.random()
            if make in _UNSPACED:
                out += "" if glue < 0.85 else " "
            elif make in (_thai, _lao):
                out += " "
            elif glue < 0.06 and make is _english and out[-1] == "." and out[-2].islower() and s[0].isupper() and not out.endswith(("etc.", "m.")):
                out += ""
            else:
                out += " " if glue < 0.8 else "\n" if glue < 0.92 else "  "
        out += s
        ends.append(len(out))
    return out, ends
