"""Profiles: position-specific scoring matrices read from and written to text, JSON and rows.

A profile is small and lives on the driver; operators send it to the executors with their tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

import numpy as np

NLOW = -16383  # "forbidden"
MLOW = -12285  # the least sum of two scores
LETTERS, UNKNOWN, DEL, STOP, WIDTH = 26, 0, 27, 28, 29
D, X, M, I = range(4)  # states; a transition from a to b is at 4 * a + b
STATES = "DXMI"
TRANSITIONS = {a + b: 4 * STATES.index(a) + STATES.index(b) for a in "MID" for b in "MID"}
BOUNDARIES = ["B0", "B1", "E0", "E1", "BM", "BI", "BD", "BE", "ME", "IE", "DE"]
MAX_ITEMS, MAX_TAGS = 8, 32
FUNCTIONS = ["LINEAR", "GLE_ZSCORE", "GLE_ZSCAVE"]


class ProfileError(ValueError):
    """A profile that cannot be read."""


@dataclass
class Profile:
    identification: str = ""
    ac: str = ""
    date: str = ""
    description: str = ""
    type: str = "MATRIX"
    alphabet: str = ""
    length: int = 0
    circular: bool = False
    definition: str = "UNIQUE"
    n1: int = 1
    n2: int = 0
    normalization: list[dict] = field(default_factory=list)
    cutoff: list[dict] = field(default_factory=list)
    consensus: str = ""
    pattern: str = ""
    match: np.ndarray | None = None  # length x WIDTH; DEL holds the deletion score
    insertion: np.ndarray | None = None  # (length + 1) x WIDTH
    boundary: np.ndarray | None = None  # (length + 1) x 11
    transition: np.ndarray | None = None  # (length + 1) x 16

    @property
    def lut(self) -> np.ndarray:
        """Alphabet position of each byte: letters of either case, others and undeclared ones 0."""
        table = np.zeros(256, np.int64)
        for i, c in enumerate(self.alphabet, 1):
            table[ord(c)] = table[ord(c.lower())] = i
        return table

    def level(self, level: int = 0) -> dict:
        """The cut-off of a level."""
        for item in self.cutoff:
            if item["level"] == level:
                return item
        raise ProfileError(f"no cut-off of level {level}")

    def mode(self, mode: int | None = None) -> dict:
        """The normalisation of a mode; by default the one whose priority is smallest."""
        found = [n for n in self.normalization if mode is None or n["mode"] == mode]
        if not found:
            raise ProfileError(f"no normalisation of mode {mode}")
        return min(found, key=lambda n: n["priority"])

    def level_mode(self, level: int = 0, mode: int = 1) -> tuple[dict, dict, float]:
        """(cut-off, normalisation, normalised cut-off) of a mode within a level."""
        cut, norm = self.level(level), self.mode(mode)
        if mode not in cut["modes"]:
            raise ProfileError(f"level {level} has no mode {mode}")
        return cut, norm, cut["n_score"][cut["modes"].index(mode)]

    def tables(self, complete_cycles: bool = False) -> dict[str, np.ndarray]:
        """Entry and exit scores: transition with X filled in, first (entry on row 0), last (exit on the last row)."""
        b = {name: self.boundary[:, i].astype(np.int64) for i, name in enumerate(BOUNDARIES)}
        t = self.transition.astype(np.int64).copy()
        col = np.arange(self.length + 1)
        no = np.full(self.length + 1, NLOW)
        if self.circular and complete_cycles:
            inner_in, outer_in, inner_out, outer_out = b["B1"], b["B0"], b["E0"], b["E1"]
        else:
            inner_in, outer_in = (np.where(col >= self.n2, no, b[k]) for k in ("B1", "B0"))
            inner_out, outer_out = (np.where(col < self.n1, no, b[k]) for k in ("E1", "E0"))
        first, last = np.full((self.length + 1, 4), NLOW), np.full((self.length + 1, 4), NLOW)
        for state, name in ((M, "M"), (I, "I"), (D, "D")):
            t[:, 4 * X + state] = np.maximum(inner_in + b["B" + name], MLOW)
            t[:, 4 * state + X] = np.maximum(inner_out + b[name + "E"], MLOW)
            first[:, state] = np.maximum(outer_in + b["B" + name], MLOW)
            last[:, state] = np.maximum(outer_out + b[name + "E"], MLOW)
        t[:, 4 * X + X] = NLOW
        return {"transition": t, "first": first, "last": last}

    def reversed(self) -> Profile:
        """The profile that scores reversed sequences alike."""
        swap = [BOUNDARIES.index(k) for k in ("E0", "E1", "B0", "B1", "ME", "IE", "DE", "BE", "BM", "BI", "BD")]
        flip = [4 * b + a for a in range(4) for b in range(4)]
        return replace(
            self,
            consensus=self.consensus[::-1],
            n1=self.length - self.n2 + 1,
            n2=self.length - self.n1 + 1,
            match=self.match[::-1].copy(),
            insertion=self.insertion[::-1].copy(),
            boundary=self.boundary[::-1][:, swap].copy(),
            transition=self.transition[::-1][:, flip].copy(),
        )

    def complemented(self, iupac: bool = False) -> Profile:
        """The profile whose alphabet letters are swapped with their complements."""
        pairs = "ATCGMKRYVBHD" if iupac else "ATCG"
        other = {a: b for a, b in zip(pairs, "TAGCKMYRBVDH"[: len(pairs)], strict=True)}
        return replace(self, alphabet="".join(other.get(c, c) for c in self.alphabet))


def _score(text: str) -> int:
    text = text.strip()
    if text == "*":
        return NLOW
    try:
        value = int(text)
    except ValueError as e:
        raise ProfileError(f"not a score: {text!r}") from e
    if not -32768 <= value <= 32767:
        raise ProfileError(f"score out of range: {value}")
    return value


def _scores(text: str, count: int) -> list[int]:
    parts = [_score(x) for x in text.split(",")]
    return parts * count if len(parts) == 1 else parts


def _quoted(text: str) -> str:
    found = re.search(r"'([^']*)'", text)
    return found[1] if found else text


def _tags(text: str) -> list[tuple[str, str]]:
    out = []
    for item in re.findall(r"(?:[^;']|'[^']*')+", text):
        key, eq, value = item.partition("=")
        if key.strip():
            out.append((key.strip(), value.strip() if eq else ""))
    if len(out) > MAX_TAGS:
        raise ProfileError(f"more than {MAX_TAGS} tags on a line")
    return out


class _Rows:
    """The rows of one kind, and the defaults a new row starts from."""

    def __init__(self):
        self.match = np.zeros(WIDTH, np.int64)
        self.insertion = np.zeros(WIDTH, np.int64)
        self.match[STOP] = self.insertion[STOP] = NLOW
        self.boundary = np.zeros(len(BOUNDARIES), np.int64)
        for name in ("BI", "BD", "BE", "DE", "IE"):
            self.boundary[BOUNDARIES.index(name)] = NLOW
        self.transition = np.zeros(16, np.int64)
        for name in ("MI", "MD", "ID", "IM", "DM", "DI"):
            self.transition[TRANSITIONS[name]] = NLOW
        self.symbol = "X"

    def copy(self) -> _Rows:
        new = _Rows.__new__(_Rows)
        new.__dict__ = {k: v.copy() if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}
        return new

    def set_match(self, key: str, value: str) -> bool:
        if key == "M0":
            self.match[UNKNOWN] = _score(value)
        elif key == "M":
            got = _scores(value, LETTERS)
            self.match[1 : 1 + len(got)] = got
        elif key == "D":
            self.match[DEL] = _score(value)
        else:
            return False
        return True

    def set_insertion(self, key: str, value: str) -> None:
        if key in BOUNDARIES:
            self.boundary[BOUNDARIES.index(key)] = _score(value)
        elif key in TRANSITIONS:
            self.transition[TRANSITIONS[key]] = _score(value)
        elif key == "I0":
            self.insertion[UNKNOWN] = _score(value)
        elif key == "I":
            got = _scores(value, LETTERS)
            self.insertion[1 : 1 + len(got)] = got
        else:
            raise ProfileError(f"unknown key {key}")


class _Parser:
    def __init__(self):
        self.profile, self.default = Profile(), _Rows()
        self.matches: list[_Rows] = []
        self.insertions: list[_Rows] = []
        self.symbols: list[str] = []
        self.last = ""

    def line(self, line: str) -> None:
        p, code, rest = self.profile, line[:2], line[5:].rstrip()
        if code == "ID":
            name, _, kind = rest.partition(";")
            p.identification, p.type = name.strip(), kind.strip().rstrip(".").strip() or "MATRIX"
        elif code == "AC":
            p.ac = rest.strip().rstrip(";")
        elif code == "DT":
            p.date = rest
        elif code == "DE":
            p.description += rest
        elif code == "PA":
            p.pattern += rest.strip()
        elif code == "MA":
            if p.type == "PATTERN":
                raise ProfileError("a pattern has no matrix lines")
            self.matrix(rest.strip())

    def matrix(self, text: str) -> None:
        found = re.match(r"/(\w+):\s*", text)
        again = not found
        if found:
            self.last, text = found[1], text[found.end() :]
        tags, p = _tags(text), self.profile
        if self.last == "GENERAL_SPEC":
            for key, value in tags:
                if key == "ALPHABET":
                    p.alphabet = _quoted(value)
                    if len(p.alphabet) > LETTERS:
                        raise ProfileError("the alphabet is too large")
                elif key == "LENGTH":
                    p.length = p.n2 = int(value)
                elif key == "TOPOLOGY":
                    p.circular = value == "CIRCULAR"
        elif self.last == "DISJOINT":
            p.n1, p.n2 = 1, p.length
            for key, value in tags:
                if key == "DEFINITION":
                    p.definition = value
                elif key in ("N1", "N2"):
                    setattr(p, key.lower(), int(value))
        elif self.last == "NORMALIZATION":
            self.item(p.normalization, {"mode": 0, "priority": 0, "function": "LINEAR", "text": "", "r": [0.0] * 5}, tags)
        elif self.last == "CUT_OFF":
            self.item(p.cutoff, {"level": 0, "score": 0, "h_score": 0, "text": "", "n_score": [], "modes": []}, tags)
        elif self.last == "DEFAULT":
            if not tags:
                self.default = _Rows()
            for key, value in tags:
                if key == "SY_M":
                    self.default.symbol = _quoted(value)
                elif key != "SY_I" and not self.default.set_match(key, value):
                    self.default.set_insertion(key, value)
        elif self.last == "M":
            if not again:
                if len(self.insertions) < len(self.matches) + 1:
                    self.insertions.append(self.default.copy())
                self.matches.append(self.default.copy())
                self.symbols.append(self.default.symbol)
            for key, value in tags:
                if key == "SY":
                    self.symbols[-1] = _quoted(value)
                elif not self.matches[-1].set_match(key, value):
                    raise ProfileError(f"unknown key {key}")
        elif self.last == "I":
            if not again:
                if len(self.matches) < len(self.insertions):
                    self.matches.append(self.default.copy())
                    self.symbols.append(self.default.symbol)
                self.insertions.append(self.default.copy())
            for key, value in tags:
                if key != "SY":
                    self.insertions[-1].set_insertion(key, value)

    @staticmethod
    def item(items: list[dict], new: dict, tags: list[tuple[str, str]]) -> None:
        if len(items) >= MAX_ITEMS:
            raise ProfileError(f"more than {MAX_ITEMS} normalisations or cut-offs")
        for key, value in tags:
            if key == "FUNCTION":
                new["function"] = "GLE_ZSCORE" if value == "GRIBSKOV" else value
                if new["function"] not in FUNCTIONS:
                    raise ProfileError(f"unknown function {value}")
            elif key == "TEXT":
                new["text"] = _quoted(value)
            elif key == "MODE" and "modes" in new:
                new["modes"] = [int(x) for x in value.split(",")]
            elif key in ("MODE", "PRIORITY", "LEVEL", "SCORE", "H_SCORE"):
                new[key.lower()] = int(value)
            elif key == "N_SCORE":
                new["n_score"] = [float(np.float32(x)) for x in value.split(",")]
            elif re.fullmatch("R[1-5]", key):
                new["r"][int(key[1]) - 1] = float(np.float32(value))
        items.append(new)

    def end(self) -> Profile:
        p = self.profile
        if p.type == "PATTERN":
            p.pattern = p.pattern.rstrip(".")
            return p
        if len(self.insertions) == p.length:
            self.insertions.append(self.default.copy())
        if len(self.matches) != p.length or len(self.insertions) != p.length + 1:
            raise ProfileError(f"{len(self.matches)} match and {len(self.insertions)} insertion lines for length {p.length}")
        if not any(c["level"] == 0 for c in p.cutoff):
            raise ProfileError("no cut-off of level 0")
        p.consensus = "".join(self.symbols)
        p.match = np.stack([r.match for r in self.matches])
        p.insertion, p.boundary, p.transition = (np.stack([getattr(r, k) for r in self.insertions]) for k in ("insertion", "boundary", "transition"))
        return p


def parse_profiles(text: str) -> list[Profile]:
    """All profiles of a text, each ended by a line of two slashes."""
    out, parser, used = [], _Parser(), False
    for line in text.splitlines():
        if line.startswith("//"):
            out.append(parser.end())
            parser, used = _Parser(), False
        elif line.strip():
            parser.line(line)
            used = True
    if used:
        out.append(parser.end())
    return out


def _value(x: int) -> str:
    return "*" if x <= NLOW else str(x)


def write_profile(p: Profile, comments: Iterable[str] = ()) -> str:
    """Text that parse_profiles reads back to the same profile."""
    lines = [f"ID   {p.identification}; {p.type}.", f"AC   {p.ac};", f"DT   {p.date}", f"DE   {p.description}"]
    if p.type == "PATTERN":
        return "\n".join([*lines, f"PA   {p.pattern}.", "//", ""])
    lines.append(f"MA   /GENERAL_SPEC: ALPHABET='{p.alphabet}'; LENGTH={p.length};" + (" TOPOLOGY=CIRCULAR;" if p.circular else ""))
    lines.append(f"MA   /DISJOINT: DEFINITION={p.definition}; N1={p.n1}; N2={p.n2};")
    for n in p.normalization:
        r = " ".join(f"R{i}={x:.9g};" for i, x in enumerate(n["r"], 1))
        lines.append(f"MA   /NORMALIZATION: MODE={n['mode']}; PRIORITY={n['priority']}; FUNCTION={n['function']}; {r} TEXT='{n['text']}';")
    for c in p.cutoff:
        scores, modes = ",".join(f"{x:.9g}" for x in c["n_score"]), ",".join(map(str, c["modes"]))
        lines.append(f"MA   /CUT_OFF: LEVEL={c['level']}; SCORE={c['score']}; H_SCORE={c['h_score']};" + (f" N_SCORE={scores};" if scores else "") + (f" MODE={modes};" if modes else "") + f" TEXT='{c['text']}';")
    for i in range(p.length + 1):
        edge = " ".join(f"{n}={_value(x)};" for n, x in zip(BOUNDARIES, p.boundary[i], strict=True))
        move = " ".join(f"{n}={_value(p.transition[i, k])};" for n, k in TRANSITIONS.items())
        lines += [f"MA   /I: I0={_value(p.insertion[i, 0])}; I={','.join(map(_value, p.insertion[i, 1 : LETTERS + 1]))};", f"MA   {edge}", f"MA   {move}"]
        if i < p.length:
            lines.append(f"MA   /M: SY='{p.consensus[i]}'; M0={_value(p.match[i, 0])}; M={','.join(map(_value, p.match[i, 1 : LETTERS + 1]))}; D={_value(p.match[i, DEL])};")
    return "\n".join([*lines, *(f"CC   {c}" for c in comments), "//", ""])


def profile_json(p: Profile) -> str:
    """Name, alphabet, cut-off and the score columns as JSON."""
    columns = [{"match": p.match[i, 1 : len(p.alphabet) + 1].tolist(), "deletion": int(p.match[i, DEL]), "insertion": p.insertion[i, 1 : len(p.alphabet) + 1].tolist()} for i in range(p.length)]
    return json.dumps({"ac": p.ac, "description": p.description, "length": p.length, "alphabet": p.alphabet, "cutoff": p.level(0)["score"], "consensus": p.consensus, "columns": columns})


def profile_rows(profiles: list[Profile]) -> tuple[list[dict], list[dict]]:
    """Rows of the tables profiles and profile_pos."""
    heads, rows = [], []
    for k, p in enumerate(profiles):
        heads.append({"profile_id": k, **{n: getattr(p, n) for n in ("identification", "ac", "date", "description", "type", "alphabet", "length", "circular", "n1", "n2", "consensus", "normalization", "cutoff")}})
        t = p.tables()
        for i in range(p.length + 1):
            match = p.match[i - 1] if i else np.zeros(WIDTH, np.int64)
            rows.append({"profile_id": k, "pos": i, "match": match[: LETTERS + 1].tolist(), "del": int(match[DEL]), "insertion": p.insertion[i, : LETTERS + 1].tolist(), "boundary": p.boundary[i].tolist(), "transition": t["transition"][i].tolist(), "first": t["first"][i].tolist(), "last": t["last"][i].tolist()})
    return heads, rows


def simple_profile(word: str, alphabet: str, match: int = 3, mismatch: int = -1, gap: int = -3, cutoff: int = 0, circular: bool = False) -> Profile:
    """A profile of a word: one score for its letters, one for any other, linear gaps, free ends."""
    n = len(word)
    lines = [
        f"ID   {word}; MATRIX.",
        "AC   XX00000;",
        f"MA   /GENERAL_SPEC: ALPHABET='{alphabet}'; LENGTH={n};" + (" TOPOLOGY=CIRCULAR;" if circular else ""),
        f"MA   /DISJOINT: DEFINITION=PROTECT; N1=1; N2={n};",
        "MA   /NORMALIZATION: MODE=1; FUNCTION=LINEAR; R1=0.0; R2=0.1; TEXT='n';",
        f"MA   /CUT_OFF: LEVEL=0; SCORE={cutoff}; N_SCORE={cutoff / 10}; MODE=1; TEXT='!';",
        f"MA   /DEFAULT: M0={mismatch}; D={gap}; I={gap}; I0={gap}; MI=0; MD=0; IM=0; DM=0;",
    ]
    for c in word:
        lines.append(f"MA   /M: SY='{c}'; M={','.join(str(match if a == c else mismatch) for a in alphabet)};")
    return parse_profiles("\n".join([*lines, "//"]))[0]


def parse_accessions(text: str) -> list[tuple[str, str, str]]:
    """(accession, name, state) of the DR lines; state is one of T P N F or another letter."""
    found = (re.findall(r"([^,;]+),([^,;]+),\s*(\S)\s*;", line[5:]) for line in text.splitlines() if line.startswith("DR"))
    return [(a.strip(), n.strip(), s) for line in found for a, n, s in line]
