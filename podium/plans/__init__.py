"""Bindings of the operators onto the test tables: registered queries and their oracles."""
