"""The registered queries over the supplied tables, each with its SQL twin where SQL can say it."""
