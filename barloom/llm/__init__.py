"""Work on training texts: one module per operator, their queries in ``queries``."""
