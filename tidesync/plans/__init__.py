"""Jobs built from the operators: clone, publish, forward merge, registered queries."""
