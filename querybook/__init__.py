"""Every operator as a query over the test tables, next to SQL that gives the same rows."""
