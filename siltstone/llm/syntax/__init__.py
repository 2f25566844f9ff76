"""Packrat parsing-expression grammars of six languages over whole files."""
