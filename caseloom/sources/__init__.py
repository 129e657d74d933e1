"""Readers, landed-file parsers, table writers and exports."""
