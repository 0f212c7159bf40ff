"""Facts from texts: the only stage that runs in Python; all later stages are plans over its rows."""
