"""Citations and operators of raw text as column expressions: automata over the tokens of a text.

A text is taken apart into an array of tokens that, joined again, are the text; each token is judged by itself or by its
neighbours and replaced, and the array is joined. So a bracket is judged by its own grammar and an operator by the
operands around it without look-behind of unknown length, and SQL can say the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import cleaning
from lectern.functions.text import JS_SPACE, clean_marks, js_trim

# The grammar of references; names, dates and page marks are fixed values.
_PREFIX = "(?:" + "|".join(sorted(cleaning.NAME_PREFIXES)) + ")"
_JOINER = "(?:" + "|".join(sorted(cleaning.NAME_JOINERS)) + ")"
_NAME = r"\p{Lu}[\p{L}\p{M}'’.\-]*"
_AUTHOR = f"(?:{_PREFIX} )*{_NAME}(?:(?: (?:{_NAME}|{_JOINER}))* {_NAME})?"
_AUTHORS = rf"{_AUTHOR}(?: ?[,&] ?{_AUTHOR})*(?: et al\.?)?"
_DATE = r"(?:(?:18|19|20)[0-9]{2}[a-z]?|s\. ?f\.)"
_PAGES = r"(?:pp?\.|págs?\.) ?[0-9]+(?: ?[\-–] ?[0-9]+)?"
_REFERENCE = f"{_AUTHORS}(?: ?, ?{_DATE})+(?: ?, ?{_PAGES})?"
#: What stands in a citation's brackets once spaces are single; and numbers, in square ones.
CITATION = rf"^(?:(?:[iI][bB][iI][dD]\.?|[iI][dD][eE][mM]|[oO][pP]\.? ?[cC][iI][tT]\.?)|{_REFERENCE}(?: ?; ?{_REFERENCE})*)$"
NUMBERS = r"^[0-9]+(?: ?[\-,;] ?[0-9]+)*$"
ROUND = rf"(\([^()]{{1,{cleaning.ROUND_LIMIT}}}\)|[^(]+|\()"
SQUARE = rf"(\[[^\[\]]{{1,{cleaning.SQUARE_LIMIT}}}\]|[^\[]+|\[)"


def _inside(token: Column) -> Column:
    return F.regexp_replace(F.substring(token, F.lit(2), F.length(token) - 2), f"[{JS_SPACE}]+", " ")


def is_citation(token: Column, square: bool = False) -> Column:
    """Whether a token in brackets, if it is one, holds nothing but references."""
    plain = F.trim(F.translate(_inside(token), "*_`~", ""))
    plain = F.regexp_replace(plain, " +", " ")
    cited = plain.rlike(CITATION)
    return (F.length(token) > 2) & token.endswith("]" if square else ")") & (cited | F.trim(_inside(token)).rlike(NUMBERS) if square else cited)


def _without(text: Column, pattern: str, square: bool) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    opened = "[" if square else "("
    return F.when(text.contains(opened), F.array_join(F.transform(tokens, lambda t: F.when(t.startswith(opened) & is_citation(t, square), F.lit(" ")).otherwise(t)), "")).otherwise(text)


def without_citations(text: Column) -> Column:
    """A text whose brackets that hold nothing but references are a space each."""
    return _without(_without(text, ROUND, False), SQUARE, True)


RUN = r"[\p{L}\p{M}\p{N}]"
TOKEN = rf"(?s)({RUN}+|!=|<=|>=|[{JS_SPACE}]+|.)"
OPERAND = r"^(?:\p{N}+|\p{L}[\p{M}\p{N}]*)$"
ALWAYS = ("!=", "+", "=", "≤", "≥", "≠", "×", "÷")
BETWEEN = ("<=", ">=", "*", "^", "<", ">", "/")


def spoken_operators(line: Column) -> Column:
    """A line with operators in words: some always, those that prose uses otherwise only between two operands."""
    tokens = F.regexp_extract_all(line, F.lit(TOKEN), F.lit(1))
    words = F.create_map(*(F.lit(x) for pair in sorted(cleaning.SPOKEN.items()) for x in pair))

    def replaced(ts: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            space = lambda k: F.coalesce(F.get(ts, k).rlike(f"^[{JS_SPACE}]"), F.lit(False)).cast("int")
            before = F.get(ts, i - 1 - space(i - 1))
            j = i + 1 + space(i + 1)
            signed = F.coalesce(F.get(ts, j).isin("+", "-"), F.lit(False))
            after = F.when(signed, F.get(ts, j + 1 + space(j + 1))).otherwise(F.get(ts, j))
            y_or_o = (t == "/") & F.coalesce(F.lower(F.get(ts, i - 1)).endswith("y") & F.lower(F.get(ts, i + 1)).startswith("o"), F.lit(False))
            between = t.isin(*BETWEEN) & ~y_or_o & F.coalesce(before.isin(")", "]") | before.rlike(OPERAND), F.lit(False)) & F.coalesce(after.isin("(", "[") | after.rlike(OPERAND), F.lit(False))
            return F.when(t.isin(*ALWAYS) | between, F.concat(F.lit(" "), F.element_at(words, t), F.lit(" "))).otherwise(t)

        return F.array_join(F.transform(ts, one), "")

    # through an array of one, so that the line is taken apart once
    return F.when(line.rlike("[!+=≤≥≠×÷*/^<>]"), F.transform(F.array(tokens), replaced)[0]).otherwise(line)


_DIVIDER = rf"^[{JS_SPACE}]*(?:={{3,}}|-{{3,}}|(?:\*[{JS_SPACE}]*){{3,}}|(?:_[{JS_SPACE}]*){{3,}})[{JS_SPACE}]*$"


def cleaned_line(line: Column) -> Column:
    """A line for reading aloud: nothing of a divider, operators in words, without marks, its spaces tidied."""
    return F.when(line.rlike(_DIVIDER), F.lit("")).otherwise(clean_marks(spoken_operators(line)))


def cleaned_text(text: Column) -> Column:
    """A text of plain letters (nothing to normalise) without citations, line by line as cleaned_line()."""
    return js_trim(F.array_join(F.transform(F.split(without_citations(text), "\n"), cleaned_line), "\n"))
