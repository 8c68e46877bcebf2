"""Reading and writing tables, and the stand-in tables the queries run on."""
