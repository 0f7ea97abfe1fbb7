"""Street addresses in parts, as column expressions over the words of an address, seen from its end.

An address is read as ``[building] house [prefix] street suffix ... [city] [state] [zip]``. The word that anchors it
is the last one that is a street suffix or may be a street's name; what stands left of the anchor is told by the
places of its first number and of its first compass word. So a parse is a few searches in an array of words, which
stay inside the JVM.

Null and empty texts have no parts. What stands right of the anchor, or between its parts, and is no part of its
own names the apartment.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = ["house", "prefix", "street", "suffix", "apartment", "building", "city", "state", "zip"]
#: Fixed values, from the postal standard: compass words before a street.
PREFIXES = {
    "e": "E.", "east": "E.", "n": "N.", "ne": "NE.", "north": "N.", "northeast": "NE.", "northwest": "NW.", "nw": "NW.", "s": "S.", "se": "SE.", "south": "S.",
    "southeast": "SE.", "southwest": "SW.", "sw": "SW.", "w": "W.", "west": "W.",
}
#: Fixed values, from the postal standard: states. Only names of one word can match a word.
STATES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE", "Florida": "FL",
    "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME",
    "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV",
    "New Hampshire": "NH", "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY", "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK",
    "Oregon": "OR", "Pennsylvania": "PA", "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT",
    "Vermont": "VT", "Virginia": "VA", "Washington": "WA", "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
}
#: Fixed values, from the postal standard: the commonest street suffixes. ``read_suffixes`` reads longer lists.
SUFFIXES = {
    "ALLEY": "ALY", "AV": "AVE", "AVENUE": "AVE", "BEND": "BND", "BOULEVARD": "BLVD", "BRIDGE": "BRG", "BYPASS": "BYP", "CAUSEWAY": "CSWY", "CENTER": "CTR", "CIRCLE": "CIR",
    "COURT": "CT", "COVE": "CV", "CREEK": "CRK", "CRESCENT": "CRES", "CROSSING": "XING", "DRIVE": "DR", "ESTATE": "EST", "EXPRESSWAY": "EXPY", "EXTENSION": "EXT",
    "FREEWAY": "FWY", "GARDENS": "GDNS", "GLEN": "GLN", "GREEN": "GRN", "GROVE": "GRV", "HEIGHTS": "HTS", "HIGHWAY": "HWY", "HILL": "HL", "HILLS": "HLS", "HOLLOW": "HOLW",
    "ISLAND": "IS", "JUNCTION": "JCT", "LAKE": "LK", "LANDING": "LNDG", "LANE": "LN", "LOOP": "LOOP", "MANOR": "MNR", "MEADOWS": "MDWS", "MOUNTAIN": "MTN",
    "PARK": "PARK", "PASS": "PASS", "PATH": "PATH", "PIKE": "PIKE", "PLACE": "PL", "PLAZA": "PLZ", "POINT": "PT", "RIDGE": "RDG", "ROAD": "RD", "ROW": "ROW", "RUN": "RUN",
    "SQUARE": "SQ", "STATION": "STA", "STREET": "ST", "SUMMIT": "SMT", "TERRACE": "TER", "TRACE": "TRCE", "TRAIL": "TRL", "TURNPIKE": "TPKE", "VALLEY": "VLY", "VIEW": "VW",
    "VILLAGE": "VLG", "VISTA": "VIS", "WALK": "WALK", "WAY": "WAY",
}
#: What surely names an apartment wherever it stands.
APARTMENT = r"#\w+ rm \w+|#\w+-\w|\bapt #?\w+|\bapartment #?\w+|#\w+|\brm \w+|\bunits? #?\w+|- #?\w+|\bno\s?\d+\w*|\b(?:townhouse )?style\s\w{1,2}\b"
#: How many units a building has is no part of an address.
UNITS = r"-{0,2}\w+ units"
#: What begins a post-office box.
BOX = r"\bP\.?O\.?\b|\bbox\b|p\.?o\.?box"


def read_suffixes(path: str) -> dict[str, str]:
    """Long forms and abbreviations from a file of LONG,ABBR lines."""
    with open(path) as f:
        return dict(line.strip().split(",") for line in f if line.count(",") == 1)


def capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])


def _place(words: Column, test) -> Column:
    """Where the first word stands that passes; null where none does."""
    found = F.array_position(F.transform(words, lambda w: F.coalesce(test(w), F.lit(False))), F.lit(True))
    return F.nullif(found, F.lit(0))


def _slice(words: Column, first: Column, last: Column) -> Column:
    """Words first to last; none where there are none between."""
    return F.when(last >= first, F.slice(words, first.cast("int"), (last - first + 1).cast("int"))).otherwise(F.array().cast("array<string>"))


def _joined(words: Column) -> Column:
    """Words that are held from the last to the first, as they stood; null where there are none."""
    return F.when(F.size(words) > 0, F.array_join(F.reverse(words), " "))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _without(words: Column, at: Column) -> Column:
    return F.when(at.isNull(), words).otherwise(F.filter(words, lambda w, i: i + 1 != at))


def parsed_address(text: Column | str, suffixes: dict[str, str] | None = None, cities: Sequence[str] = ()) -> Column:
    """struct of PARTS; nulls for what is absent. ``cities``: names of one word, looked for where there is a comma."""
    text = F.col(text) if isinstance(text, str) else text
    known = SUFFIXES if suffixes is None else suffixes
    forms = _literal_map(known | {short: short for short in known.values()})
    codes = _literal_map({name.upper(): code for name, code in STATES.items()} | {code: code for code in STATES.values()})
    compass = _literal_map(PREFIXES)
    commas = F.contains(text, F.lit(","))

    def suffix_of(w: Column) -> Column:
        return F.element_at(forms, F.upper(w))

    def before_suffix(words: Column, test) -> Column:
        """Where a word stands that passes, if there is a comma and no suffix after the word."""
        at, suffix = _place(words, test), _place(words, lambda w: suffix_of(w).isNotNull() & ~F.coalesce(test(w), F.lit(False)))
        return F.when(commas & (suffix.isNull() | (at < suffix)), at)

    def cleaned(plain: Column) -> Column:
        """What can be told wherever it stands; then the words that are left, from the last to the first."""
        inside = F.nullif(F.regexp_extract(plain, r"\((.*)\)", 1), F.lit(""))

        def split(plain: Column) -> Column:
            sure = F.get(F.reverse(F.regexp_extract_all(plain, F.lit(f"(?i)({APARTMENT})"), F.lit(1))), F.lit(0))
            words = F.filter(F.split(F.regexp_replace(plain, f"(?i){APARTMENT}", ""), r"\s+"), lambda w: w != "")
            return _let(sure, lambda sure: _let(F.reverse(words), lambda words: ended(words, sure, inside)))

        return _let(F.regexp_replace(plain, r"\(.*\)", ""), split)

    def ended(words: Column, sure: Column, inside: Column) -> Column:
        """The zip code, and where there is a comma state and city, before any suffix."""
        zip_ = F.when(F.get(words, F.lit(0)).rlike(r"^\d{5}$"), F.get(words, F.lit(0)))
        rest = F.when(zip_.isNotNull(), F.filter(words, lambda _, i: i > 0)).otherwise(words)

        def with_state(words: Column, at: Column) -> Column:
            state = F.element_at(codes, F.upper(F.get(words, at - 1)))
            left = _without(words, at)
            if not cities:
                return _let(left, lambda words: anchored(words, sure, inside, F.lit(None).cast("string"), state, zip_))
            return _let(left, lambda words: _let(F.when(sure.isNull(), before_suffix(words, lambda w: F.lower(w).isin(*cities))), lambda at: with_city(words, at, state)))

        def with_city(words: Column, at: Column, state: Column) -> Column:
            return _let(_without(words, at), lambda left: anchored(left, sure, inside, capital(F.get(words, at - 1)), state, zip_))

        return _let(rest, lambda words: _let(before_suffix(words, lambda w: F.element_at(codes, F.upper(w)).isNotNull()), lambda at: with_state(words, at)))

    def anchored(words: Column, sure: Column, *said: Column) -> Column:
        """The anchor: a suffix with the word before it, or a word that may be a street's name."""
        anchor = _place(words, lambda w: suffix_of(w).isNotNull() | (w.rlike("^[A-Za-z]") & (F.length(w) > 2) & ~F.lower(w).isin("apt", "apartment")))

        def at(anchor: Column) -> Column:
            suffix = suffix_of(F.get(words, anchor - 1))
            return _let(suffix, lambda suffix: _let(anchor + F.when(suffix.isNotNull(), 1).otherwise(0), lambda named: named_(anchor, suffix, named)))

        def named_(anchor: Column, suffix: Column, named: Column) -> Column:
            has_street = named <= F.size(words)
            rest = F.when(has_street, _slice(words, named + 1, F.size(words))).otherwise(F.array().cast("array<string>"))
            places = lambda rest: F.struct(_place(rest, lambda w: w.rlike(r"^\d")).alias("house"), _place(rest, lambda w: F.element_at(compass, F.lower(w)).isNotNull()).alias("prefix"))
            return _let(rest, lambda rest: _let(places(rest), lambda at: parts(words, anchor, suffix, F.when(has_street, F.get(words, named - 1)), rest, at["house"], at["prefix"], sure, *said)))

        return _let(anchor, at)

    def parts(words, anchor, suffix, name, rest, house_at, prefix_at, sure, inside, city, state, zip_) -> Column:
        stop = F.coalesce(F.least(house_at, prefix_at), F.size(rest) + 1)
        longer = F.when(suffix.isNotNull(), stop - 1).otherwise(0)  # so many more words of the street's name
        street = F.when(name.isNotNull(), _joined(F.transform(F.concat(F.array(name), _slice(rest, F.lit(1), longer)), capital)))
        # left of the house number is the building; what is left over names the apartment
        house_end = F.coalesce(house_at, F.size(rest) + 1)
        free = lambda i: ~(i + 1).eqNullSafe(prefix_at) & (i + 1 > longer)
        building = _joined(F.filter(rest, lambda _, i: free(i) & (i + 1 > house_end)))
        over = F.concat(_slice(words, F.lit(1), F.coalesce(anchor - 1, F.size(words))), F.filter(rest, lambda _, i: free(i) & (i + 1 < house_end)))
        over = F.filter(over, lambda w: w.rlike(r"^[#\w]"))
        found = {
            "house": F.regexp_extract(F.get(rest, house_at - 1), "^[^/-]*", 0), "prefix": F.element_at(compass, F.lower(F.get(rest, prefix_at - 1))), "street": street,
            "suffix": F.concat(capital(suffix), F.lit(".")), "apartment": F.coalesce(F.get(F.reverse(over), F.lit(0)), sure),
            "building": F.nullif(F.concat_ws(" ", building, inside), F.lit("")), "city": city, "state": state, "zip": zip_,
        }
        return F.struct(*[found[p].alias(p) for p in PARTS])

    plain = F.replace(F.replace(F.translate(F.trim(text), ".,", ""), F.lit("# "), F.lit("#")), F.lit(" & "), F.lit("&"))
    return _let(F.regexp_replace(plain, f"(?i){UNITS}", ""), cleaned)


def street_line(text: Column | str, suffixes: dict[str, str] | None = None) -> Column:
    """House, prefix, street and suffix in upper case, ASCII only; null stays."""
    text = F.col(text) if isinstance(text, str) else text
    line = _let(parsed_address(text, suffixes), lambda p: F.concat_ws(" ", p["house"], p["prefix"], p["street"], p["suffix"]))
    return F.when(text.isNotNull(), F.upper(F.regexp_replace(line, r"[^\x00-\x7F]", "")))


def street_line_or_box(text: Column | str, suffixes: dict[str, str] | None = None) -> Column:
    """The same, but for post-office boxes, which stay, and texts whose line has fewer than five characters."""
    text = F.col(text) if isinstance(text, str) else text
    own = (text == "") | text.rlike(f"(?i)^({BOX})")
    return F.when(own, text).otherwise(_let(street_line(text, suffixes), lambda line: F.when(F.length(line) < 5, text).otherwise(line)))


def house_line(text: Column | str, suffixes: dict[str, str] | None = None) -> Column:
    """House and street in upper case, as voters' addresses are compared; null where either is absent."""
    text = F.col(text) if isinstance(text, str) else text
    return _let(parsed_address(text, suffixes), lambda p: F.when(p["house"].isNotNull() & p["street"].isNotNull(), F.concat_ws(" ", p["house"], F.upper(p["street"]))))
