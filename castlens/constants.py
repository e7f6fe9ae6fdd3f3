"""Values that must equal the reference jobs' for the same results.

Fixed values, stated plainly and kept together:
"""

# Fixed values.
UNREACHED = 10000                      # distance reported for a person not reached within the depth limit
DEFAULT_SOURCE = "nm0000102"           # default origin person of the search
DEFAULT_DEPTH = 6                      # default depth limit of the capped search
ACTING_ROLES = ("actor", "actress")    # the role set of the per-actor average and of the search
PRODUCER_ROLE = "producer"             # the single role of the per-producer average
NULL_MARKER = "\\N"                    # null field in the tab-separated dumps
HEADER_KEY = "tconst"                  # first field of a header line in the dumps
WORD_SEPARATORS = "[ \t\n\r\f]+"       # token separators of word count: space, tab, newline, carriage return, form feed
REPLICAS = 61                          # copies made by the replication step: the table plus 60 unions
LIST_ROW = ("[", ",", "]")             # printed row: [a,b]
TUPLE_ROW = ("(", ",", ")")            # printed tuple: (a,b)
