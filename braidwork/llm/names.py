"""Names as people type them: parts, nicknames, initials, and a true edit metric."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Texts that mark an absent value, in lower case.
ABSENT = ("", "-", "--", "---", "?", "??", "n/a", "na", "#n/a", "null", "none", "nan", "nil", "unknown", "tbd", "not given", "no name", ".")
# Titles and letters after a name; kinds of firm; other common words of firms' names with their short forms.
TITLES = frozenset("mr mrs ms miss dr prof sir herr frau phd md mba esq jr sr ii iii".split())
FIRM_FORMS = {"inc": "inc", "incorporated": "inc", "llc": "llc", "ltd": "ltd", "limited": "ltd", "gmbh": "gmbh", "ag": "ag", "aktiengesellschaft": "ag", "co": "co", "company": "co", "group": "group", "grp": "group", "bv": "bv", "sa": "sa", "corp": "corp", "corporation": "corp", "plc": "plc", "kg": "kg", "firm": "", "the": ""}
FIRM_WORDS = {
    "international": "international", "intl": "international", "int": "international", "manufacturing": "manufacturing", "mfg": "manufacturing", "manuf": "manufacturing", "brothers": "brothers", "bros": "brothers",
    "european": "european", "europ": "european", "euro": "european", "eur": "european", "trading": "trading", "trad": "trading", "trdg": "trading", "partners": "partners", "ptnrs": "partners", "partner": "partners",
}
TRADES = frozenset("glass cycles timber foods interiors textiles packaging tooling printing instruments chemicals bearings paper motors seeds ceramics fittings hardware optics logistics tools plastics energy".split())
# Short forms of given names, each after the full names it may stand for.
NICKNAMES = {
    "adrian": "ade", "agnes": "aggie nessie", "albert": "al bert bertie", "alexander": "alex al sandy xander lex", "alice": "allie ali", "amelia": "millie amy mia mel", "andrew": "andy drew", "anna": "annie ann nan",
    "anthony": "tony ant", "barbara": "barb babs barbie", "beatrice": "bea trixie bee", "benjamin": "ben benny benji", "bernard": "bernie", "bettina": "tina betty", "caroline": "carrie caro carol", "catherine": "cathy cat kate katie kit",
    "charles": "charlie chuck chas", "christine": "chris chrissie tina christy", "christopher": "chris kit topher", "clara": "clare", "conrad": "con connie", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debby",
    "dominic": "dom nick", "donald": "don donny", "dorothy": "dot dottie dolly dory", "edgar": "ed eddie", "edward": "ed eddie ted ned teddy", "eleanor": "nell ellie nora ella nellie", "elizabeth": "liz lizzie beth betty eliza bess libby",
    "emilia": "em emmy millie emily mila", "eric": "rick ricky", "esther": "essie hettie", "eugene": "gene", "felix": "fel", "florence": "flo florrie flossie", "frances": "fran frankie fanny", "frederick": "fred freddie freddy",
    "gabriel": "gabe", "george": "georgie", "gerald": "gerry jerry", "gregory": "greg", "greta": "gretel", "gustav": "gus", "hannah": "hanna", "harold": "harry hal", "helena": "lena nell helen", "henry": "harry hank hal", "hugo": "huey",
    "irene": "rene", "isabella": "bella izzy belle isa", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn", "jeremy": "jerry jem", "joanna": "jo joan", "jonathan": "jon jonny johnny", "joseph": "joe joey",
    "josephine": "jo josie", "judith": "judy jude", "julian": "jules", "katherine": "kate kathy katie kat kit kitty", "kenneth": "ken kenny", "laurence": "larry laurie", "leonard": "leo len lenny", "leopold": "leo poldi", "lillian": "lil lily lilly",
    "louis": "lou louie", "lucas": "luke", "lydia": "lyddie liddy", "magdalena": "magda lena maggie", "marcus": "marc mark", "margaret": "peggy maggie meg marge margie greta", "maria": "mary mia", "martha": "marty mattie patty", "martin": "marty",
    "matthew": "matt matty", "maximilian": "max", "michael": "mike mick mickey", "mildred": "millie mil", "natalie": "nat nattie", "nathaniel": "nat nate nathan", "nicholas": "nick nicky klaus", "oliver": "ollie olly", "olga": "ola",
    "oscar": "ozzie", "pamela": "pam", "patricia": "pat patty trish patsy tricia", "patrick": "pat paddy", "paula": "polly", "peter": "pete", "philip": "phil pip", "priscilla": "cilla prissy", "rachel": "rae", "raymond": "ray", "rebecca": "becky becca",
    "reginald": "reg reggie", "richard": "dick rick rich ricky", "robert": "bob rob bobby robbie bert", "rosalind": "roz ros rosie", "rupert": "rupe", "samuel": "sam sammy", "sarah": "sally sadie", "sebastian": "seb bas", "sidney": "sid syd",
    "sofia": "sophie fia", "stanley": "stan", "stephanie": "steph steffi", "stephen": "steve stevie", "susanna": "sue susie suzy", "sylvia": "syl sylvie", "theodore": "ted theo teddy", "theresa": "tess terry tessa", "thomas": "tom tommy",
    "timothy": "tim timmy", "valentina": "val tina", "vanessa": "nessa nessie van", "victor": "vic", "victoria": "vicky tori vic", "vincent": "vince vinny", "walter": "walt wally", "wilhelmina": "mina billie willa wilma", "william": "bill will billy willy",
    "winifred": "winnie freda", "yvonne": "von evie", "zachary": "zack zach",
}
GIVEN = frozenset(NICKNAMES) | frozenset("nadine karin klara viola nora ines jasper ida ruth ursula".split())
_FULL: dict[str, frozenset[str]] = {}
for _full, _short in NICKNAMES.items():
    for _s in _short.split():
        _FULL[_s] = _FULL.get(_s, frozenset()) | {_full}

_SPELL = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "ı": "i", "æ": "ae", "œ": "oe", "đ": "d", "’": None, "'": None, "`": None})


def fold(text: str) -> str:
    """Lower case without accents."""
    t = unicodedata.normalize("NFKD", text.lower().translate(_SPELL))
    return "".join(c for c in t if not unicodedata.combining(c))


def is_absent(text: str | None) -> bool:
    return text is None or text.strip().lower() in ABSENT


@lru_cache(maxsize=200_000)
def edit_distance(a: str, b: str, limit: int = 3) -> int:
    """Levenshtein distance with transpositions restricted to neighbours costing 1 (optimal string alignment); limit + 1 if it is more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            c = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, before[j - 2] + 1)
            row.append(c)
        if min(row) > limit:
            return limit + 1
        before, last = last, row
    return min(last[-1], limit + 1)


def near(a: str, b: str) -> bool:
    """Whether one may be a slip of the other: one slip from 4 letters, two from 8."""
    n = min(len(a), len(b))
    most = 0 if n < 4 else 1 if n < 8 else 2
    return a == b or (most > 0 and edit_distance(a, b, 3) <= most)


@lru_cache(maxsize=200_000)
def parse(text: str | None) -> tuple[str, str, str, tuple[str, ...]]:
    """kind (person, firm or absent), family (a firm's own word), given ('' if none; ends with '.' if cut short), rest (a firm's other words, a person's initials)."""
    if is_absent(text):
        return ("absent", "", "", ())
    t = fold(text)
    t = re.sub(r"\([^)]*\)|\"[^\"]*\"", " ", t)
    raw = text.strip()
    t = re.sub(r"\b([a-z])\.([a-z])\.(?=\s|$|,)", r"\1\2 ", t)  # m.d., s.a., b.v.
    t = t.replace("&", " ")
    comma = t.split(",")
    words = [[w for w in re.findall(r"[a-z]+(?:-[a-z]+)*\.?", part)] for part in comma]
    flat = [w for part in words for w in part]
    bare = [w.rstrip(".") for w in flat]
    if any(w in FIRM_FORMS or w in FIRM_WORDS or w in TRADES for w in bare) and not any(w in GIVEN for w in bare):
        rest, own = set(), []
        for w in bare:
            if w in FIRM_FORMS:
                continue
            if w in FIRM_WORDS:
                rest.add(FIRM_WORDS[w])
            elif w in TRADES:
                rest.add(w)
            elif len(w) > 2:
                own.append(w)
        if own:
            return ("firm", max(own, key=len), "", tuple(sorted(rest)))
    parts = [[w for w in part if w.rstrip(".") not in TITLES] for part in words]
    parts = [p for p in parts if p]
    if not parts:
        # other scripts are one word each; a name without any letter is none
        own = "".join(ch for ch in t if ch.isalpha())
        return ("person", own, "", ()) if own and not flat else ("absent", "", "", ())
    if len(parts) >= 2:
        family_part, given_part = parts[0], parts[1]
        family = max((w.rstrip(".") for w in family_part), key=len)
        order = given_part
    else:
        p = parts[0]
        long = [w for w in p if len(w.rstrip(".")) > 1]
        if not long:
            return ("absent", "", "", ())
        if len(long) == 1:
            family, order = long[0].rstrip("."), [w for w in p if w is not long[0]]
            if family in GIVEN and order == []:
                return ("person", "", family, ())
        else:
            first, last = long[0], long[-1]
            f, b = first.rstrip("."), last.rstrip(".")
            upper = [w for w in re.findall(r"[^\W\d_][\w'’-]*", raw) if len(w) > 1]
            shouted = len(upper) >= 2 and upper[0].isupper() and not upper[-1].isupper()
            turned = shouted or (is_given(b) and not is_given(f)) or (last.endswith(".") and not first.endswith("."))
            family, order = (f, [w for w in p if w is not first]) if turned else (b, [w for w in p if w is not last])
    given = next((w for w in order if len(w.rstrip(".")) > 1), "")
    initials = tuple(w.rstrip(".") for w in order if len(w.rstrip(".")) == 1)
    if not given and initials:
        return ("person", family, initials[0] + ".", initials[1:])
    return ("person", family, given, initials)


def is_given(w: str) -> bool:
    return w in GIVEN or w in _FULL


@lru_cache(maxsize=100_000)
def fulls(given: str) -> frozenset[str]:
    """The full names that a given name as written may stand for."""
    g = given.rstrip(".")
    out = {g} | _FULL.get(g, frozenset())
    return frozenset(out)


@lru_cache(maxsize=200_000)
def given_agree(a: str, b: str) -> float:
    """1 same or a short form or slip of the same, 0.6 an initial or a cut-off name that fits, 0.5 unknown, 0 in conflict."""
    if not a or not b:
        return 0.5
    x, y = a.rstrip("."), b.rstrip(".")
    if x == y and len(x) > 1:
        return 1.0
    fa, fb = fulls(a), fulls(b)
    if len(x) == 1 or len(y) == 1:
        fits = any(p[0] == q[0] for p in fa for q in fb)
        return 0.6 if fits else 0.0
    if fa & fb:
        return 1.0
    cut = lambda s, full: s.endswith(".") and any(f.startswith(s.rstrip(".")) or near(f[: len(s) - 1], s.rstrip(".")) for f in full)
    if cut(a, fb) or cut(b, fa):
        return 0.8
    if x not in GIVEN and any(near(x, q) for q in fb) or y not in GIVEN and any(near(y, p) for p in fa):
        return 0.95
    return 0.0


@lru_cache(maxsize=200_000)
def name_agree(a: str | None, b: str | None) -> float | None:
    """How far two names may be one: None if either is absent, 0 in conflict, up to 1."""
    ka, fa, ga, ra = parse(a)
    kb, fb, gb, rb = parse(b)
    if ka == "absent" or kb == "absent":
        return None
    if ka == "firm" or kb == "firm":
        if ka != kb:
            return 0.3 if near(fa, fb) else 0.0
        if not near(fa, fb):
            return 0.0
        sa, sb = set(ra), set(rb)
        trades = (sa & TRADES, sb & TRADES)
        if trades[0] and trades[1] and not trades[0] & trades[1] and not any(near(p, q) for p in trades[0] for q in trades[1]):
            return 0.1
        return 1.0 if sa == sb else 0.9
    if not fa or not fb:
        return 0.5 * given_agree(ga, gb)
    same = 1.0 if fa == fb else 0.9 if near(fa, fb) else 0.85 if ("-" in fa) != ("-" in fb) and (set(fa.split("-")) & set(fb.split("-"))) else 0.0
    if same == 0.0 and "-" in fa and "-" in fb and near(fa.replace("-", ""), fb.replace("-", "")):
        same = 0.9
    return same * given_agree(ga, gb)


def email_key(text: str | None) -> str | None:
    """An address without wrapping, case and tag; null if it has no single @ between a name and a host."""
    if text is None:
        return None
    t = re.sub(r"^mailto:", "", text.strip().lower().strip("<> \t"))
    m = re.fullmatch(r"([^@\s]+)@([^@\s]+)", t)
    if not m:
        return None
    local = m.group(1).split("+")[0]
    return f"{local}@{m.group(2)}" if local else None
