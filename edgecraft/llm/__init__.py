"""Training-data operators: one module per operator, thin queries in
:mod:`edgecraft.llm.queries`.  Nothing outside this package imports it."""
