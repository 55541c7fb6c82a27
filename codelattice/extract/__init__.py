"""From source text to the rows of a code graph: language rules, scanners, framework facts and the table function over files."""
