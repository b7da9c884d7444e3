"""Operators for preparing language-model training text, and their queries.

Nothing else in the library imports this subpackage.  ``queries`` registers
one ``opN_<name>`` per operator (``QUERIES``) and the DuckDB SQL where SQL can
express the result (``ORACLES``).
"""

from helpdeck.llm.queries import ORACLES, QUERIES  # noqa: F401
