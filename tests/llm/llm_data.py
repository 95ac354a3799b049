"""Paths and hostile rows for the tests of the training-data operators."""

SF = "/root/testdata/sf0.01"

#: Columns that clash with names used inside the operators.
EXTRA = "row_key string, start string, fp string, kind string, words string, spans string, score string, rank string"

ODD_TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One  two"), (6, "a b c d e f g"), (7, "A B\nC d e f g"),
    (8, "x" * 30_000), (9, "word " * 20_000), (None, "a null id here"), (None, "a null id here"), (11, "12345 !!"),
    (12, "mail a.b@c.de, b@d@e.f.g+h@i.j or 1.2.3.4.5.6.7.8 and 999.1.1.1"), (12, "mail a.b@c.de, b@d@e.f.g+h@i.j or 1.2.3.4.5.6.7.8 and 999.1.1.1"),
    (13, "card 4111 1111 1111 1111, 4111-1111-1111-1112 and \U0001F600 +1 (743) 555-3824. +12 3"), (14, "ÉÈÊ straße İstanbul   z"),
    (15, "4" * 5000), (16, "+1" * 3000), (17, "a@" * 3000 + "b.c"), (18, "1." * 3000), (19, "<|endoftext|> don't 'S x́"),
]
