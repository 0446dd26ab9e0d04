"""Options, site context, and the label query language."""
