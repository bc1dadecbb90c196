"""Plans: staged tables, global ranks and the dictionary object."""
