"""Table operators, each from DataFrame to DataFrame: documents, lines, units, modules, kinds, text, blocks."""
