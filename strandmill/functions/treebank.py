"""Word tokens by the rules of the Penn Treebank's published script: an ordered list of rewritings, then a split at blanks.

The rules are written in what Java's and RE2's regular expressions share, so the same list makes the column and the SQL. A text is one
sentence: only a period at its end is cut off, with the closing marks behind it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandmill.functions.text import let

#: The script's rewritings, in its order.
RULES = (
    (r'^"', "`` "), (r'([ (\[{<])"', r"\1 `` "),
    (r"\.\.\.", " ... "), (r"([,;:@#$%&])", r" \1 "),
    (r"([^.])(\.)([\])}>\"']*)[ \t]*$", r"\1 \2\3 "), (r"([?!])", r" \1 "),
    (r"([\]\[(){}<>])", r" \1 "), ("--", " -- "),
    ("^", " "), ("$", " "), ('"', " '' "),
    (r"([^'])' ", r"\1 ' "), (r"'([sSmMdD]) ", r" '\1 "),
    ("'ll ", " 'll "), ("'re ", " 're "), ("'ve ", " 've "), ("n't ", " n't "), ("'LL ", " 'LL "), ("'RE ", " 'RE "), ("'VE ", " 'VE "), ("N'T ", " N'T "),
    (r" ([Cc])annot ", r" \1an not "), (r" ([Dd])'ye ", r" \1' ye "), (r" ([Gg])imme ", r" \1im me "), (r" ([Gg])onna ", r" \1on na "), (r" ([Gg])otta ", r" \1ot ta "),
    (r" ([Ll])emme ", r" \1em me "), (r" ([Mm])ore'n ", r" \1ore 'n "), (r" '([Tt])is ", r" '\1 is "), (r" '([Tt])was ", r" '\1 was "), (r" ([Ww])anna ", r" \1an na "),
)


#: What a text has to hold for a rule to change it, where that is quicker to look for than the rule's pattern.
NEEDED = {
    r'^"': '"', r'([ (\[{<])"': '"', r"\.\.\.": "...", r"([^.])(\.)([\])}>\"']*)[ \t]*$": ".", r"([^'])' ": "' ", r"'([sSmMdD]) ": "'", r" ([Cc])annot ": "annot ", r" ([Dd])'ye ": "'ye ", r" ([Gg])imme ": "imme ",
    r" ([Gg])onna ": "onna ", r" ([Gg])otta ": "otta ", r" ([Ll])emme ": "emme ", r" ([Mm])ore'n ": "ore'n ", r" '([Tt])is ": "is ", r" '([Tt])was ": "was ", r" ([Ww])anna ": "anna ",
}


def _ruled(out: Column, pattern: str, to: str) -> Column:
    if pattern in "^$":
        return F.concat(F.lit(to), out) if pattern == "^" else F.concat(out, F.lit(to))
    if pattern == '"' or pattern.strip("'-lreventLREVENT ") == "":  # no sign of a pattern
        return F.replace(out, F.lit(pattern), F.lit(to))
    # Java refers to a group by $, which is a plain sign in the script's replacements.
    change = lambda x: F.regexp_replace(x, pattern, to.replace("$", r"\$").replace(r"\1", "$1").replace(r"\2", "$2").replace(r"\3", "$3"))
    need = NEEDED.get(pattern)
    return change(out) if need is None else let(out, lambda x: F.when(F.contains(x, F.lit(need)), change(x)).otherwise(x))


def tokens(text: Column) -> Column:
    """The tokens of a text; null and blank texts have none. Line breaks are blanks."""
    out = F.translate(F.coalesce(text, F.lit("")), "\r\n", "  ")
    for pattern, to in RULES:
        out = _ruled(out, pattern, to)
    return F.filter(F.split(out, "[ \t]+"), lambda x: x != "")


def sql(text: str) -> str:
    """The same as an expression of DuckDB."""
    out = f"regexp_replace(coalesce({text}, ''), '[\\r\\n]', ' ', 'g')"
    for pattern, to in RULES:
        quote = lambda x: x.replace("'", "''")
        out = f"regexp_replace({out}, '{quote(pattern)}', '{quote(to)}', 'g')"
    return f"list_filter(regexp_split_to_array({out}, '[ \\t]+'), lambda x: x <> '')"
