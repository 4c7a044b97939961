"""Checksums and number validity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _ints(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _dihedral() -> list[int]:
    """Multiplication table of the dihedral group D5, row after row.

    Elements 0-4 are rotations and 5-9 reflections.
    """
    table = []
    for a in range(10):
        for b in range(10):
            turn = (a + b) if a < 5 else (a - b)
            flip = (a >= 5) != (b >= 5)
            table.append(turn % 5 + (5 if flip else 0))
    return table


def _positions() -> list[int]:
    """The position permutation applied 0 to 7 times, row after row."""
    # fixed value: the base permutation of the Verhoeff scheme
    base = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    rows = [list(range(10))]
    while len(rows) < 8:
        rows.append([base[v] for v in rows[-1]])
    return [v for row in rows for v in row]


_D5 = _dihedral()
_POS = _positions()
_INVERSE = [next(b for b in range(10) if _D5[a * 10 + b] == 0) for a in range(10)]


#: Digits up to which a number is worked out as one chain of look-ups, which Spark compiles; a fold runs step by step.
UNROLLED = 12


def _verhoeff_chain(number: Column, shift: int) -> Column:
    """The same as the fold for at most ``UNROLLED`` digits. A digit that is absent has code 0 and changes nothing."""
    found = F.lit(0)
    for i in range(UNROLLED):
        row = (i + shift) % 8 * 10
        permuted = F.get(_ints([0] * ord("0") + _POS[row:row + 10]), F.ascii(F.substring(number, -1 - i, 1)))
        found = F.get(_ints(_D5), found * 10 + permuted)
    return found


def _verhoeff_fold(number: Column, shift: int) -> Column:
    """Fold a digit string from its right end; ``shift`` is 1 when the check digit is missing."""
    short = number.rlike(rf"^[0-9]{{1,{UNROLLED}}}\z")
    return F.when(short, _verhoeff_chain(number, shift)).otherwise(_verhoeff_steps(number, shift))


def _verhoeff_steps(number: Column, shift: int) -> Column:
    digits = F.transform(F.split(F.reverse(number), ""), lambda d: d.cast("int"))

    def step(acc: Column, digit: Column) -> Column:
        i, c = acc["i"], acc["c"]
        permuted = F.element_at(_ints(_POS), ((i + shift) % 8 * 10 + digit + 1).cast("int"))
        return F.struct(
            (i + 1).alias("i"),
            F.element_at(_ints(_D5), (c * 10 + permuted + 1).cast("int")).alias("c"),
        )

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("c"))
    return F.aggregate(digits, start, step, lambda acc: acc["c"])


def verhoeff_valid(number: Column) -> Column:
    """True for a digit string whose last digit is its Verhoeff check digit."""
    return F.when(number.rlike("^[0-9]+$"), _verhoeff_fold(number, 0) == 0).otherwise(False)


def verhoeff_check_digit(number: Column) -> Column:
    """The digit to append to a digit string, as text."""
    return F.element_at(_ints(_INVERSE), _verhoeff_fold(number, 1) + 1).cast("string")


def luhn_valid(number: Column) -> Column:
    """True for a digit string that passes the Luhn check."""
    return F.call_function("luhn_check", number)


def iban_valid(value: Column) -> Column:
    """ISO 13616 check: move the first four characters last, letters to 10-35, modulo 97 is 1."""
    compact = F.regexp_replace(F.upper(value), r"\s", "")
    turned = F.concat(F.substr(compact, F.lit(5)), F.left(compact, F.lit(4)))

    def step(acc: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    shape = compact.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")
    return F.when(shape, F.aggregate(F.split(turned, ""), F.lit(0), step) == 1).otherwise(False)
