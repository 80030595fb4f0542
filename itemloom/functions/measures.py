"""Interest measures of a rule, as SQL over the counts of its sides.

``n_both`` transactions have both sides, ``n_left`` and ``n_right`` one of them, out
of ``n``.
"""

SUPPORT = "n_both / n"
CONFIDENCE = "n_both / n_left"
LIFT = "(n_both / n_left) / (n_right / n)"
