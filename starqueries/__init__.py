"""The library applied to the star-schema test tables: views, registered queries, oracle SQL."""
