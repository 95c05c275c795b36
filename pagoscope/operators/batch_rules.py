"""K1: row rules over Arrow batches, for checks that SQL texts do not express well.

A batch rule is a :class:`Rule` like the others: its code column comes from an Arrow function
that takes the named columns as arrays and returns an array of codes, null where the row
passes. It stands in the same pass as the rules in SQL, in the registry's order, and its codes
are counted like theirs. Functions are shipped by value (nested, importing what they use), so
executors need pyarrow and numpy but not this package.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F, types as T

from pagoscope.operators.quality_rules import WARNING, Rule


def batch_rule(
    name: str, level: str, columns: tuple[str, ...], check: Callable,
    families: tuple[str, ...] | None, closed: bool = False,
) -> Rule:
    """A rule whose codes ``check`` works out from arrays of ``columns``, batch by batch.

    ``columns`` may name payment columns or the parsed helpers of ``quality_rules``.
    """
    run = F.arrow_udf(check, T.StringType())
    return Rule(name, level, lambda: run(*[F.col(c) for c in columns]), families, closed)


# Fixed values of ISO 13616: shape of an account number and the remainder of a valid one.
IBAN_SHAPE = r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"
IBAN_MODULUS, IBAN_REMAINDER = 97, 1
IBAN_CODES = ("iban_formato_invalido", "iban_digito_control")


def _iban_check(shape: str, modulus: int, remainder: int, codes: tuple[str, str]) -> Callable:
    def check(iban):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # only spaces may group the characters; letters of either case count
        text = pc.replace_substring(pc.ascii_upper(pc.fill_null(iban, "")), " ", "")
        shaped = pc.match_substring_regex(text, shape).to_numpy(zero_copy_only=False)
        out = np.full(len(text), None, object)
        out[~shaped & pc.not_equal(text, "").to_numpy(zero_copy_only=False)] = codes[0]
        rows = np.flatnonzero(shaped)
        if len(rows):
            wide = np.array(text.take(pa.array(rows)).to_pylist(), "S34")
            marks = wide.view(np.uint8).reshape(len(rows), 34).astype(np.int64)
            left = np.zeros(len(rows), np.int64)
            # country and check digits count last; a letter stands for two digits
            for place in [*range(4, 34), *range(4)]:
                mark = marks[:, place]
                letter = mark >= 65
                value = np.where(letter, mark - 55, mark - 48)
                read = (left * np.where(letter, 100, 10) + value) % modulus
                left = np.where(mark == 0, left, read)
            out[rows[left != remainder]] = codes[1]
        return pa.array(out, pa.string())

    return check


def iban_rule(level: str = WARNING, column: str = "iban") -> Rule:
    """The account number has the shape of an IBAN and its check digits are right.

    A null or blank number passes, as the layout does not require one.
    """
    check = _iban_check(IBAN_SHAPE, IBAN_MODULUS, IBAN_REMAINDER, IBAN_CODES)
    return batch_rule("iban", level, (column,), check, IBAN_CODES, closed=True)
