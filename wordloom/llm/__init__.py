"""Training-data operators (one module each), their registered queries and
oracle SQL.  Nothing else in the library imports this subpackage."""
