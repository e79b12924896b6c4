"""Named queries over the input tables, each with the SQL that must agree with it."""
