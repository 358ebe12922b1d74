from __future__ import annotations

import json

import numpy as np
import pytest

from tesserae.plans.catalogue import SAMPLE
from tesserae.sources.profiles import DEL, MLOW, NLOW, TRANSITIONS, D, M, ProfileError, X, parse_accessions, parse_profiles, profile_json, profile_rows, simple_profile, write_profile

CIRCLE = """ID   CAG_REPEAT; MATRIX.
AC   XX00001;
MA   /GENERAL_SPEC: ALPHABET='ACGT'; LENGTH=3; TOPOLOGY=CIRCULAR;
MA   /DISJOINT: DEFINITION=PROTECT; N1=1; N2=3;
MA   /NORMALIZATION: MODE=1; FUNCTION=LINEAR; R1=0.5; R2=0.1; TEXT='norm';
MA   /CUT_OFF: LEVEL=0; SCORE=20; N_SCORE=2.5; MODE=1; TEXT='!';
MA   /DEFAULT: D=-20; I=-20; MI=-30; MD=-30; IM=0; DM=0;
MA   /M: SY='C'; M=-10,10,-10,-10;
MA   /M: SY='A'; M=10,-10,-10,*;
MA   B1=5;
MA   /M: SY='G'; M=-10,-10,10,-10;
//
"""


def test_reads_every_kind_of_line():
    p = parse_profiles(SAMPLE)[0]
    assert (p.identification, p.type, p.ac, p.length, p.alphabet, p.n1, p.n2, p.consensus) == ("SAMPLE", "MATRIX", "XX00002", 3, "CEPSV", 1, 3, "VCP")
    assert p.match[0, :6].tolist() == [-1, -1, -1, -1, -1, 4] and p.match[0, DEL] == -3
    assert p.transition[1, TRANSITIONS["MI"]] == -2 and p.transition[0, TRANSITIONS["MI"]] == -1
    assert p.transition[0, TRANSITIONS["ID"]] == NLOW
    assert [c["level"] for c in p.cutoff] == [1, 0] and p.level(0)["score"] == 5
    assert p.level_mode(0, 1)[2] == 1.75


def test_tables_by_zone():
    t = parse_profiles(SAMPLE)[0].tables()
    enter, leave = t["transition"][:, 4 * X + M], t["transition"][:, 4 * M + X]
    assert enter.tolist() == [0, 0, 0, MLOW] and leave.tolist() == [MLOW, 0, 0, 0]
    assert t["first"][:, M].tolist() == [0, 0, 0, MLOW] and t["last"][:, D].tolist() == [MLOW] * 4


def test_round_trip_and_reverse():
    for p in (parse_profiles(SAMPLE)[0], simple_profile("ACGT", "ACGT", circular=True)):
        q = parse_profiles(write_profile(p, ["a comment"]))[0]
        for name in ("match", "insertion", "boundary", "transition"):
            assert (getattr(p, name) == getattr(q, name)).all()
        assert (p.circular, p.cutoff, p.normalization, p.consensus) == (q.circular, q.cutoff, q.normalization, q.consensus)
        twice = p.reversed().reversed()
        assert all((getattr(p, n) == getattr(twice, n)).all() for n in ("match", "insertion", "boundary", "transition"))
    assert simple_profile("AC", "ACGT").complemented().alphabet == "TGCA"


def test_reversed_profile_scores_reversed_sequences():
    from tesserae.operators.kernels import Kernel

    p = simple_profile("ACGTT", "ACGT")
    a, b = Kernel(p), Kernel(p.reversed())
    for text in ("ACGTT", "TACGTTA", "AGTT", "GGACGTAATT"):
        assert a.best_scores([a.encode(text)])[0] == b.best_scores([b.encode(text[::-1])])[0]


def test_continuation_star_and_list():
    with pytest.raises(ProfileError, match="unknown key B1"):
        parse_profiles(CIRCLE)
    p, q = parse_profiles(CIRCLE.replace("MA   B1=5;\n", "") + SAMPLE)
    assert p.circular and p.match[1, 4] == NLOW and q.ac == "XX00002"


@pytest.mark.parametrize(
    ("old", "new"),
    [("LEVEL=0", "LEVEL=2"), ("LENGTH=3", "LENGTH=4"), ("LENGTH=3", "LENGTH=2"), ("M0=-1", "M0=40000"), ("M0=-1", "M0=a"), ("LINEAR", "CUBIC"), ("MATRIX", "PATTERN"), ("MI=-2", "QQ=-2")],
)
def test_errors(old, new):
    with pytest.raises(ProfileError):
        parse_profiles(SAMPLE.replace(old, new))


def test_pattern_json_rows_and_accessions():
    assert parse_profiles("ID   P; PATTERN.\nPA   C-x(2)-C.\n//\n")[0].pattern == "C-x(2)-C"
    p = parse_profiles(SAMPLE)[0]
    assert json.loads(profile_json(p))["columns"][0]["match"] == [-1, -1, -1, -1, 4]
    heads, rows = profile_rows([p])
    assert len(heads) == 1 and [r["pos"] for r in rows] == [0, 1, 2, 3] and len(rows[1]["match"]) == 27
    assert np.array(rows[0]["first"]).shape == (4,)
    assert parse_accessions("DR   P12345, NAME_HUMAN, T; Q99999, OTHER, F;\n") == [("P12345", "NAME_HUMAN", "T"), ("Q99999", "OTHER", "F")]
