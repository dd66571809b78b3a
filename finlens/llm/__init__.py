"""Training-data operators (text extraction, dedup, scoring, mixing).

Nothing else in the library imports this subpackage.  ``queries`` registers
one thin ``opN_<name>`` query per operator.
"""
